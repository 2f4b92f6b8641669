"""Secret scan: three base patterns, and a battery of randomness tests.

DataFrame expressions only. Base kinds are regular expressions; their positions come
from the lengths of the matches and of the texts between them, summed inside the row.

The battery looks at other long runs of encoding characters. For each, the encoding
is inferred (hex, base32, base62, base64, one case of letters), and three tests ask
whether it could be random in that alphabet:

* chi-squared of the symbol counts against equal counts (Wilson-Hilferty);
* runs of the upper and lower half of the alphabet against the runs expected;
* serial correlation of neighbouring symbols.

A run that no test rejects (at ALPHA with three tests) may be random, or may be
ordinary text too short for the tests to tell. So each such run is rated on its own: by
the likelihood ratio of the run under equal frequencies against a model of the corpus's
ordinary runs; a run that a test rejects has a ratio of 0. The model takes a symbol to
depend on its kind (upper case, lower case, digit, sign) and a kind on the one before: in
ordinary runs kinds come in stretches, in random ones they change all the time. It is
counted for each encoding over the corpus's distinct words below the length of candidates
and the longer runs that the tests reject. An ordinary run reaches a ratio of r with chance
1 / r at most, so ratios are e-values, and discoveries are controlled in each stratum of
encoding and length by the step-up rule for e-values: of m runs, the k best are reported if
the k-th has a ratio of m / (fdr k) or more. Longer runs give larger ratios, so a key
stands out among any number of ordinary runs, and where runs are too short for that none is
reported. Runs are counted once, however often they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otelframe.llm.common import documents, materialize, text_or_empty

# The base kinds in their order, pattern, and length that a match must have.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# (runs are maximal, so a bound on the run drops the same matches as one on the match)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE = (("assign", ASSIGN, 12), ("access", ACCESS, 18), ("hex", HEX, 16))

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings in the order of inference: name, what a run must match, alphabet.
ENCODINGS = (
    ("hex", "^([0-9A-F]+|[0-9a-f]+)$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]*[2-7][A-Z2-7]*$", UPPER + "234567"),
    ("letters", "^([A-Z]+|[a-z]+)$", UPPER),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", "", UPPER + LOWER + DIGITS + "+/"),
)
ALPHA = 0.01
FDR = 0.05
#: Words that the model of ordinary runs is counted over: of this form, below the length of candidates.
WORD, BELOW = r"[A-Za-z0-9+/_-]{4,}", 20
#: Kinds of symbols; ^ stands before a run.
KINDS = "ULDS"
#: Symbols and steps that what all encodings have in common weighs in the model of one, and
#: the share of changes of kind, and its weight, that is taken before any word is counted.
BELIEF, CHANGE, CHANGE_BELIEF = 64, 0.1, 10
#: Ratios are taken as whole powers of e, and no larger than this one.
MOST_POWER = 200
BLOCK = 64


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(pattern: str, text: str = "text", extra: str = "0") -> str:
    """SQL for all leftmost non-overlapping matches: array of (s, e, m, g), code point
    positions, matched text and group ``extra``.

    Positions are prefix sums, taken over blocks of matches and then within each
    block, so that a text with very many matches does not take quadratic time.
    """
    p = _quote(pattern)
    zipped = (
        f"transform(arrays_zip(transform(split({text}, {p}, -1), x -> length(x)), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {extra})), "
        "x -> named_struct('gap', x['0'], 'm', x['1'], 'g', x['2']))"
    )
    per_block = f"aggregate(slice(z, b * {BLOCK} + 1, {BLOCK}), 0, (n, x) -> n + x.gap + length(x.m))"
    inside = (
        f"aggregate(slice(z, b * {BLOCK} + 1, {BLOCK}), named_struct('at', element_at(pre, b + 1), 'out', cast(array() as array<struct<s:int,e:int,m:string,g:string>>)), "
        "(acc, x) -> named_struct('at', acc.at + x.gap + length(x.m), 'out', concat(acc.out, array(named_struct('s', acc.at + x.gap, 'e', acc.at + x.gap + length(x.m), 'm', x.m, 'g', x.g)))), acc -> acc.out)"
    )
    blocks = f"sequence(0, cast((size(z) - 1) div {BLOCK} as int))"
    prefix = f"aggregate(transform({blocks}, b -> {per_block}), array(0), (acc, n) -> concat(acc, array(element_at(acc, -1) + n)))"
    # the text after the last match is a gap without a match
    return (
        f"if({text} rlike {p}, flatten(transform(array(filter({zipped}, x -> x.m is not null)), z -> flatten(transform(array({prefix}), pre -> flatten(transform({blocks}, b -> {inside})))))), "
        "cast(array() as array<struct<s:int,e:int,m:string,g:string>>))"
    )


def base_spans(kind: str, pattern: str, least: int) -> str:
    checked = "g" if kind == "assign" else "m"
    found = matches(pattern, extra="2" if kind == "assign" else "0")
    return f"filter({found}, x -> length(x.{checked}) >= {least})"


def upper_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic form, error under 2e-4)."""
    power = 1.5976 * z + 0.07056 * z * z * z
    return 1 / (1 + F.exp(F.least(F.lit(700.0), F.greatest(F.lit(-700.0), power))))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def chi_squared_z(body: Column, alphabet: Column) -> Column:
    """Normal value of the chi-squared statistic of the symbol counts (Wilson-Hilferty)."""
    n, k = F.length(body).cast("double"), F.length(alphabet).cast("double")
    symbols = F.filter(F.split(alphabet, ""), lambda x: x != "")
    squares = _sum(F.transform(symbols, lambda x: F.pow(F.length(body) - F.length(F.replace(body, x, F.lit(""))), F.lit(2.0))))
    free = k - 1
    cube = F.pow(F.greatest(k * squares / n - n, F.lit(0.0)) / free, F.lit(1 / 3))
    return (cube - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))


def symbol_numbers(body: Column, alphabet: Column) -> Column:
    return F.transform(F.filter(F.split(body, ""), lambda x: x != ""), lambda x: (F.instr(alphabet, x) - 1).cast("double"))


def _neighbours(codes: Column, f) -> Column:
    return F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), f)


def runs_z(codes: Column, k: Column) -> Column:
    """How far the number of runs in the halves of the alphabet is from the expected one."""
    n = F.size(codes).cast("double")
    high = _sum(F.transform(codes, lambda x: F.when(x * 2 >= k, 1.0).otherwise(0.0)))
    runs = 1 + _sum(_neighbours(codes, lambda x, y: F.when((x * 2 >= k) != (y * 2 >= k), 1.0).otherwise(0.0)))
    both = 2 * high * (n - high)
    variance = both * (both - n) / (n * n * (n - 1))
    return F.when(variance > 0, F.abs(runs - 1 - both / n) / F.sqrt(variance)).otherwise(40.0)


def serial_z(codes: Column, mean: Column) -> Column:
    """Correlation of neighbouring symbols, as a normal value."""
    spread = _sum(F.transform(codes, lambda x: (x - mean) * (x - mean)))
    product = _sum(_neighbours(codes, lambda x, y: (x - mean) * (y - mean)))
    return F.when(spread > 0, F.abs(product / spread) * F.sqrt(F.size(codes).cast("double"))).otherwise(40.0)


def _choice(column: Column, pairs) -> Column:
    out = F.lit(None)
    for name, value in reversed(list(pairs)):
        out = F.when(column == name, value).otherwise(out)
    return out


def inferred(run: Column) -> Column:
    """Name of the first encoding whose pattern the run matches."""
    out = F.lit(ENCODINGS[-1][0])
    for name, pattern, _ in reversed(ENCODINGS[:-1]):
        out = F.when(run.rlike(pattern), name).otherwise(out)
    return out


def tested(candidates: Column) -> Column:
    """Candidates (s, e, m) with encoding, stratum, body (in its alphabet) and the combined
    p-value of the three tests."""
    named = F.transform(candidates, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["m"].alias("m"), inferred(c["m"]).alias("enc")))

    def spelled(c: Column) -> Column:
        body = F.when(c["enc"].isin("hex", "letters"), F.upper(c["m"])).otherwise(F.translate(c["m"], "-_", "+/"))
        alphabet = _choice(c["enc"], [(name, F.lit(a)) for name, _, a in ENCODINGS])
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), F.xxhash64(c["m"]).alias("h"), c["enc"].alias("enc"), body.alias("body"), alphabet.alias("alphabet"), symbol_numbers(body, alphabet).alias("codes"))

    def averaged(c: Column) -> Column:
        n = F.size(c["codes"])
        stratum = F.concat(c["enc"], F.lit(":"), F.floor(2 * F.log2(n.cast("double"))).cast("string"))
        return F.struct(*[c[x].alias(x) for x in ("s", "e", "h", "enc", "body", "alphabet", "codes")], stratum.alias("cls"), (_sum(c["codes"]) / n).alias("mean"))

    def rated(c: Column) -> Column:
        chi, runs, serial = chi_squared_z(c["body"], c["alphabet"]), runs_z(c["codes"], F.length(c["alphabet"]).cast("double")), serial_z(c["codes"], c["mean"])
        p = F.least(F.lit(1.0), 3 * F.least(upper_tail(chi), 2 * upper_tail(runs), 2 * upper_tail(serial)))
        return F.struct(*[c[x].alias(x) for x in ("s", "e", "h", "enc", "cls", "body")], p.alias("p"))

    return F.transform(F.transform(F.transform(named, spelled), averaged), rated)


def scanned(docs: DataFrame, text_column: str, carry: list[Column]) -> DataFrame:
    """``carry``, the base spans of each kind, and ``tested``: the candidates that touch no
    base span, rated by the battery. Written once, as it is read three times."""
    rows = docs.select(F.struct(*carry).alias("carry"), text_or_empty(text_column).alias("text"))
    for kind, pattern, least in BASE:
        rows = rows.withColumn(kind, F.expr(base_spans(kind, pattern, least)))
    free = f"filter({matches(CANDIDATE)}, c -> not (c.m rlike '^[0-9]+$') and not exists(concat(assign, access, hex), b -> b.s < c.e and c.s < b.e))"
    rows = rows.withColumn("candidates", F.expr(free)).withColumn("tested", tested(F.col("candidates")))
    return materialize(rows.select("carry", *[k for k, _, _ in BASE], "tested"))


def symbols_of(body: Column) -> Column:
    return F.filter(F.split(body, ""), lambda x: x != "")


def kinds_of(body: Column) -> Column:
    """The kind of each symbol, as a text that begins with ^."""
    return F.concat(F.lit("^"), F.translate(body, UPPER + LOWER + DIGITS + "+/-_", "U" * 26 + "L" * 26 + "D" * 10 + "SSSS"))


def steps_of(kinds: Column) -> Column:
    """Pairs of neighbouring kinds."""
    return F.transform(F.sequence(F.lit(1), F.length(kinds) - 1), lambda i: F.substring(kinds, i, F.lit(2)))


def ordinary_counts(texts: DataFrame, runs: DataFrame) -> dict[tuple[str, str], int]:
    """Occurrences, by encoding, of symbols and of steps (pairs of kinds, of runs with two
    kinds or more) in ordinary runs, and of steps with one kind of letters (under "", of
    runs with letters and digits only). Some 500 numbers reach the driver."""
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    words = words.where((F.length("w") < BELOW) & ~F.col("w").rlike("^[0-9]+$")).distinct()
    words = words.select(inferred(F.col("w")).alias("enc"), F.translate("w", "-_", "+/").alias("body"))
    held = words.unionByName(runs.where(F.col("p") < ALPHA).select("enc", "body")).withColumn("kinds", kinds_of(F.col("body")))
    none = F.array().cast("array<string>")
    steps = F.when(F.col("kinds").rlike("^.(U*|L*|D*|S*)$"), none).otherwise(steps_of(F.col("kinds")))
    folded = F.when(F.col("kinds").rlike("D") & F.col("kinds").rlike("[UL]") & ~F.col("kinds").rlike("S"), steps_of(F.translate("kinds", "L", "U"))).otherwise(none)
    mine = F.transform(F.concat(symbols_of(F.col("body")), steps), lambda x: F.struct(F.col("enc").alias("enc"), x.alias("token")))
    common = F.transform(folded, lambda x: F.struct(F.lit("").alias("enc"), x.alias("token")))
    counts = held.select(F.explode(F.concat(mine, common)).alias("x")).groupBy("x.enc", "x.token").agg(F.count(F.lit(1)).alias("n"))
    return {(r.enc, r.token): r.n for r in counts.collect()}


def ordinary_weights(counts: dict[tuple[str, str], int]) -> dict[str, tuple[list[float], list[float]]]:
    """For each encoding, the logarithms that sum up to that of a run's ratio: of its
    symbols (in the order of the alphabet), and of the steps from ^ULDS to ULDS."""
    out = {}
    for name, _, alphabet in ENCODINGS:
        one_case = LOWER[0] not in alphabet
        fold = (lambda t: t.replace("L", "U") if len(t) == 2 else t.upper()) if one_case else (lambda t: t)
        own: dict[str, float] = {}
        common: dict[str, float] = {}
        for (enc, token), n in counts.items():
            if enc == name:
                own[fold(token)] = own.get(fold(token), 0) + n
            # steps in common: with one kind of letters only where the alphabet has one
            if len(token) == 1 or one_case == (enc == ""):
                common[fold(token)] = common.get(fold(token), 0) + n
        kind = {x: "L" if x in LOWER else "U" if x in UPPER else "D" if x in DIGITS else "S" for x in alphabet}
        kinds = [k for k in KINDS if k in kind.values()]
        symbols = []
        for x in alphabet:
            peers = [y for y in alphabet if kind[y] == kind[x]]
            share = lambda y: (common.get(y, 0) + 1) / sum(common.get(z, 0) + 1 for z in peers)
            q = (own.get(x, 0) + BELIEF * share(x)) / (sum(own.get(y, 0) for y in peers) + BELIEF)
            symbols.append(-math.log(len(alphabet) * q))
        steps = []
        for before in "^" + KINDS:
            first = lambda k: 1 / len(kinds) if before == "^" or len(kinds) == 1 else 1 - CHANGE if k == before else CHANGE / (len(kinds) - 1)
            held = {k: common.get(before + k, 0) + CHANGE_BELIEF * first(k) for k in kinds}
            belief = {k: held[k] / sum(held.values()) for k in kinds}
            mine = {k: own.get(before + k, 0) + BELIEF * belief[k] for k in kinds}
            steps += [-math.log(mine[k] / sum(mine.values())) if k in kinds else 0.0 for k in KINDS]
        out[name] = (symbols, steps)
    return out


def power_of(run: Column, weights: dict[str, tuple[list[float], list[float]]]) -> Column:
    """Whole part of the logarithm of a run's likelihood ratio, MOST_POWER at most."""
    table, steps = (_choice(run["enc"], [(name, F.array(*map(F.lit, w[i]))) for name, w in weights.items()]) for i in (0, 1))
    alphabet = _choice(run["enc"], [(name, F.lit(a)) for name, _, a in ENCODINGS])
    total = _sum(F.transform(symbols_of(run["body"]), lambda x: F.element_at(table, F.instr(alphabet, x))))
    place = lambda x: (F.instr(F.lit("^" + KINDS), F.substring(x, 1, 1)) - 1) * len(KINDS) + F.instr(F.lit(KINDS), F.substring(x, 2, 1))
    total = total + _sum(F.transform(steps_of(kinds_of(run["body"])), lambda x: F.element_at(steps, place(x))))
    return F.floor(F.least(F.lit(float(MOST_POWER)), F.greatest(F.lit(-1.0), total))).cast("int")


def thresholds(runs: DataFrame, weights: dict[str, tuple[list[float], list[float]]], fdr: float = FDR) -> dict[str, int]:
    """For each stratum the least power that is reported. What reaches the driver is a
    number of runs for each stratum and power: at most 62 strata an encoding."""
    passed = F.when(F.col("p") >= ALPHA, power_of(F.struct("enc", "body"), weights)).otherwise(-1)
    counts = runs.groupBy("cls", passed.alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for cls in {r.cls for r in counts}:
        mine = sorted(((r.power, r.n) for r in counts if r.cls == cls), reverse=True)
        total, so_far = sum(n for _, n in mine), 0
        for power, n in mine:  # all runs of one power stand or fall together
            so_far += n
            if power >= 0 and power >= math.log(total / (fdr * so_far)):
                out[cls] = power
    return out


def find_secrets(docs: DataFrame, text_column: str = "text", carry: list[Column] | None = None, fdr: float = FDR) -> DataFrame:
    """``carry`` columns and ``spans``: array of (start, kind_no, end), kinds assign,
    access, hex and random, by start, then kind in this order.

    Base spans of different kinds may overlap; random ones touch no other. Null and
    empty texts have no spans; very long texts are scanned whole. Rows are independent but
    for the frequencies and strata of runs, to which repeated rows add nothing. Only the
    text and ``carry`` are read, so other columns may have any name; an empty table gives
    an empty result.
    """
    found = scanned(docs, text_column, carry or [F.col("doc_id")])
    runs = materialize(found.select(F.explode("tested").alias("t")).select("t.*").groupBy("h").agg(*[F.first(c).alias(c) for c in ("enc", "cls", "body", "p")]))
    weights = ordinary_weights(ordinary_counts(docs.select(text_or_empty(text_column).alias("text")), runs))
    least = thresholds(runs, weights, fdr)
    reported = lambda t: (t["p"] >= ALPHA) & (power_of(t, weights) >= F.coalesce(_choice(t["cls"], [(c, F.lit(n)) for c, n in sorted(least.items())]), F.lit(MOST_POWER + 1)))
    random = F.filter("tested", reported) if least else F.slice("tested", 1, 0)
    span = lambda no: lambda x: F.struct(x["s"].alias("start"), F.lit(no).alias("kind_no"), x["e"].alias("end"))
    parts = [F.transform(kind, span(i)) for i, (kind, _, _) in enumerate(BASE)] + [F.transform(random, span(len(BASE)))]
    return found.select("carry.*", F.array_sort(F.concat(*parts)).alias("spans"))


_NAMES = "array('assign', 'access', 'hex', 'random')"


def spans_text(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at({_NAMES}, x.kind_no + 1), ':', x.start, ':', x.end)), ',')")


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[secret]", fdr: float = FDR) -> DataFrame:
    """``docs`` with each span replaced by ``mark``; overlapping spans are one. Rows
    without a span are unchanged (a null text stays null). All columns are kept."""
    names = docs.columns
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_column}`").alias("text"))
    found = find_secrets(boxed, "text", [F.col("row")], fdr).withColumn("text", F.col("row").getField(text_column))
    # pieces of text between spans, in order: a span that begins before the last end only extends it
    step = (
        "aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)), "
        "(acc, x) -> named_struct('at', greatest(acc.at, x.end), 'out', if(x.start < acc.at, acc.out, concat(acc.out, array(substr(text, acc.at + 1, x.start - acc.at), " + _quote(mark) + ")))), "
        "acc -> concat(array_join(acc.out, ''), substr(text, acc.at + 1)))"
    )
    cleaned = F.when(F.size("spans") > 0, F.expr(step)).otherwise(F.col("text"))
    return found.select(*[cleaned.alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in names])


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    count = lambda no: F.expr(f"cast(size(filter(spans, x -> x.kind_no = {no})) as bigint)")
    base = found.withColumn("base", F.expr(f"filter(spans, x -> x.kind_no < {len(BASE)})"))
    return base.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text("base"), 256).alias("base_sha256"),
        spans_text("spans").alias("spans"),
    )
