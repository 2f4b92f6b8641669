"""BPE encoding by backtracking over longest matches, decoding from an offset table.

The encoder never runs merges. An Aho-Corasick automaton over all tokens gives the
tokens that start at each position of a word; the encoder takes the longest one,
and keeps it if the pair with the token before is compatible: merging the two
tokens' characters from scratch would leave a border between them. If not, it
tries the next shorter token, and goes back one token where none fits. Positions
found dead are not tried again, so a word takes linear time. A greedy run of
compatible pairs is the one sequence that the merge rules make.

Words end in a symbol of their own (the byte with the end-of-word suffix), so a
word is a string over 512 symbols.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterable

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from otelframe.llm.common import documents, map_texts
from otelframe.llm.tokens import byte_symbols, default_vocabulary

#: Entries that a worker keeps in each generation of its word memo.
CACHE_WORDS = 250_000


class Merges:
    """Token pairs and their merges, by rank: ranks order tokens as merges make them."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[list[str]], suffix: str):
        to_byte, made = byte_symbols(), {m[0] + m[1] for m in merges}
        base = [t for t in sorted(vocab, key=vocab.get) if t not in made and t.removesuffix(suffix or "\0") in to_byte]
        rank = {t: i for i, t in enumerate(base)}
        self.spelled = [chr(to_byte[t.removesuffix(suffix or "\0")] + 256 * (bool(suffix) and t != suffix and t.endswith(suffix))) for t in base]
        self.parts = [(i, i) for i in range(len(base))]
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if a + b not in rank:
                rank[a + b] = len(self.parts)
                self.parts.append((rank[a], rank[b]))
                self.spelled.append(self.spelled[rank[a]] + self.spelled[rank[b]])
            self.pairs.setdefault((rank[a], rank[b]), rank[a + b])
        self.ids = [vocab[t] for t in rank]
        self.texts = list(rank)

    def apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge of rank below ``limit`` joins what stands on the two
        sides of the border while ``left`` and ``right`` are made. The later made
        of the two tokens is taken apart first, as it was whole the shortest."""
        while True:
            if self.pairs.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, (_, inner) = left, self.parts[left]
                if inner != left:
                    left = inner
                    continue
                limit, (inner, _) = right + 1, self.parts[right]
                if inner == right:
                    return True
                right = inner
            else:
                limit, (inner, _) = right + 1, self.parts[right]
                if inner != right:
                    right = inner
                    continue
                limit, (_, inner) = left, self.parts[left]
                if inner == left:
                    return True
                left = inner


class BacktrackingEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.merges = m = Merges(spec["model"]["vocab"], spec["model"]["merges"], self.suffix)
        self.automaton = ahocorasick.Automaton()
        reached: list[bool] = []
        for t, (a, b) in enumerate(m.parts):
            reached.append(a == t or reached[a] and reached[b] and m.apart(a, b, t))
            if reached[t]:  # a token that merging its own characters does not give is never output
                self.automaton.add_word(m.spelled[t], (len(m.spelled[t]), t))
        self.automaton.make_automaton()
        self.compatible = functools.lru_cache(1 << 18)(lambda a, b: m.apart(a, b, len(m.parts)))

    def symbols(self, word: str) -> str:
        """The word's bytes as symbols, the last one marked where words have ends."""
        s = word.encode("utf-8").decode("latin-1")
        return s[:-1] + chr(256 + ord(s[-1])) if self.suffix else s

    def ranks(self, s: str) -> list[int]:
        n = len(s)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, token) in self.automaton.iter(s):
            starts[end + 1 - length].append((length, token))  # ends ascend, so lengths do
        alive, out, at, tries = [True] * (n + 1), [], [], []
        pos, k = 0, len(starts[0]) - 1 if n else -1
        while pos < n:
            options, before = starts[pos], out[-1] if out else None
            while k >= 0:
                length, token = options[k]
                if alive[pos + length] and (before is None or self.compatible(before, token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                at.append(pos)
                tries.append(k)
                pos += length
                k = len(starts[pos]) - 1 if pos < n else -1
            elif out:
                alive[pos] = False
                out.pop()
                pos, k = at.pop(), tries.pop() - 1
            else:
                raise ValueError("the vocabulary lacks a byte of this text")
        return out


class WordEncoder:
    """Whole texts of a lower-casing word BPE: NFC, white space to spaces, lower
    case, words by pattern, each word by the backtracking encoder. Special tokens
    in a text are split off first, as the library does. Text with code points that
    Python's Unicode tables lack is normalised and parted by the library's own steps, as
    its tables are newer; its words are encoded like all others."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.encoder = BacktrackingEncoder(path)
        self.library = Tokenizer.from_file(path)
        self.byte = {ord(c): b for c, b in byte_symbols().items()}
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")")
        self.added = added
        m = self.encoder.merges
        # decoding: token i's text is data[offsets[i]:offsets[i + 1]]; this vocabulary has
        # no decoder, so texts are joined by spaces, and each entry ends in one
        size = max([*m.ids, *added.values()]) + 1
        by_id = dict(zip(m.ids, m.texts)) | {i: t for t, i in added.items()}
        entries = [(by_id.get(i, "") + " ").encode() for i in range(size)]
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(e) for e in entries]))).astype(np.int64)
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.words: dict[str, list[int]] = {}

    def _ids(self, words: Iterable[str]) -> list[int]:
        out: list[int] = []
        for w in words:
            ids = self.words.get(w)
            if ids is None:
                e = self.encoder
                ids = [e.merges.ids[t] for t in e.ranks(e.symbols(w))]
                if len(self.words) >= CACHE_WORDS:
                    self.words.clear()
                if len(w) <= 64:
                    self.words[w] = ids
            out += ids
        return out

    @staticmethod
    def _written(ids: list[int]) -> tuple[int, str, bytes]:
        return len(ids), "".join([f" {i}" for i in ids]), np.array(ids, "<u4").tobytes()

    def _unknown(self, part: str) -> tuple[int, str, bytes]:
        """Of a part with code points that the tables here lack."""
        parted = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
        return self._written(self._ids(bytes(map(self.byte.__getitem__, map(ord, w))).decode() for w, _ in parted))

    def _piece(self, chunk: str) -> tuple[int, str, bytes]:
        """Number of ids, the ids in decimal, the ids as uint16 or wider bytes."""
        found = self.young.get(chunk) or self.old.get(chunk)
        if found is None:
            found = self._written(self._ids(self.word.findall(chunk)))
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        if len(chunk) <= 64:
            self.young[chunk] = found
        return found

    def pieces(self, text: str) -> list[tuple[int, str, bytes]]:
        out, young = [], self.young
        for part in self.special.split(text):
            if part in self.added:
                i = self.added[part]
                out.append((1, f" {i}", np.array([i], "<u4").tobytes()))
                continue
            if not part.isascii():
                if any(unicodedata.category(c) == "Cn" for c in set(part)):
                    out.append(self._unknown(part))
                    continue
                part = unicodedata.normalize("NFC", part)
            low = part.lower() if "Σ" not in part else "".join([c.lower() for c in part])  # no word-final form
            for chunk in low.replace("\n", " ").split(" "):
                if chunk:
                    out.append(self.young.get(chunk) or self._piece(chunk))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids and their decimal form joined by spaces."""
        p = self.pieces(text)
        return np.frombuffer(b"".join([x[2] for x in p]), "<u4"), "".join([x[1] for x in p])[1:]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts joined by spaces: one gather over the offset table."""
        starts = self.offsets[ids]
        lengths = self.offsets[ids.astype(np.int64) + 1] - starts
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        where = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.data[where].tobytes()[:-1]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode each text: id, n_tokens, ids (optional), decoded (optional),
    ids_sha256 of the decimal ids joined by one space, decoded_sha256.

    Null and empty texts have no ids and decode to an empty text. Rows are
    independent: repeated rows give repeated results, other columns are not read,
    and an empty table gives an empty result.
    """
    ddl = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def rows(batch: dict) -> dict:
        e = word_encoder(vocabulary)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
        for text in batch["text"]:
            ids, decimal = e.encode(text or "")
            decoded = e.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(decimal.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            if with_ids:
                out["ids"].append(ids.tolist())
                out["decoded"].append(decoded.decode())
        return out | {"id": batch["id"]}

    done = map_texts(docs, [F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")], ddl, rows)
    return done.withColumnRenamed("id", id_column)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), default_vocabulary("word_bpe_49k.json"), with_ids=False)
