"""BPE encoding and decoding with forced boundaries.

Two bytes that stand side by side in no token of the vocabulary can never be
merged, so a word is certain to be cut between them. Fragments between such cuts
are encoded on their own, from a cache or by merges in order of rank, and the ids
are put together. The vocabulary is a file of the tokenizers library with
byte-level symbols and a word-end suffix; its place is a parameter.

Nulls count as empty texts, which have no ids. Special tokens that stand in a
text become their ids. Composition, lower case and the classes of letters and
numbers are the library's own, whose Unicode tables are not Python's. Repeated rows
give a row each; an empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType
from tokenizers import Regex, normalizers, pre_tokenizers

from curbspark.llm.common import table

#: Words and fragments that a Python worker remembers; the caches start anew when full.
MAX_CACHED = 400_000

#: Rows that a worker codes at a time.
ROWS = 512

#: Words of up to so many bytes are merged by scanning all pairs, longer ones with a heap.
LONG = 128

_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_WHITE}]+")
#: White space to str.split(), symbols to the vocabulary's pattern.
_NOT_WHITE = re.compile("[\x1c-\x1f]")
_NONE = 1 << 60


@functools.cache
def _normalizer() -> normalizers.Normalizer:
    """The library's composition and lower case: its Unicode tables are older than Python's, and order marks differently."""
    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


@functools.cache
def _word_pattern() -> re.Pattern:
    """The word pattern. re has no classes for letters and numbers, so they are listed as the library's expressions see them."""
    # The planes beyond the third hold neither letters nor numbers.
    points = "".join(chr(p) for p in range(0x40000) if not 0xD800 <= p < 0xE000)
    classes = []
    for name in (r"\p{L}+", r"\p{N}+"):
        pieces = pre_tokenizers.Split(Regex(name), "removed").pre_tokenize_str(points)
        # What is left lies between the runs of the class.
        ends = [0, *(x for _, span in pieces for x in span), len(points)]
        runs = [(points[a], points[b - 1]) for a, b in zip(ends[::2], ends[1::2], strict=True) if a < b]
        classes.append("".join(f"\\U{ord(x):08x}-\\U{ord(y):08x}" for x, y in runs))
    letters, numbers = classes
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_WHITE}{letters}{numbers}]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordBpe(dict):
    """As a dict: what stands between white space -> its ids and its tokens, each joined by spaces."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end, ids = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {v: k for k, v in [*ids.items(), *self.special.items()]}
        self.is_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        symbols = byte_symbols()
        self.inside, self.ending = ([ids[s + x] for s in symbols] for x in ("", end))
        # Pair of ids -> rank and id of the merged token, in one number each.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a] << 20 | ids[b]] = rank << 20 | ids[a + b]
        # Byte pairs inside tokens, and those that end a word.
        byte = {s: b for b, s in enumerate(symbols)}
        self.joined: set[int] = set()
        self.joined_at_end: set[int] = set()
        for token in ids:
            ends = token.endswith(end) and token != end
            body = [byte[s] for s in (token.removesuffix(end) if ends else token)]
            pairs = [x << 8 | y for x, y in zip(body, body[1:], strict=False)]
            if ends and pairs:
                self.joined_at_end.add(pairs.pop())
            self.joined.update(pairs)
        self.words: dict[str, list[int]] = {}
        self.fragments: dict[tuple[bytes, bool], list[int]] = {}

    def cuts(self, word: bytes) -> list[int]:
        """Where the word is certain to be cut."""
        last, joined = len(word) - 1, self.joined
        out = [i for i in range(1, last) if word[i - 1] << 8 | word[i] not in joined]
        if last > 0 and word[last - 1] << 8 | word[last] not in self.joined_at_end:
            out.append(last)
        return out

    def merged(self, fragment: bytes, ends: bool) -> list[int]:
        ids = [self.inside[b] for b in fragment]
        if ends:
            ids[-1] = self.ending[fragment[-1]]
        if len(ids) > LONG:
            return self._merged_by_heap(ids)
        get = self.merges.get
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], _NONE)
        return ids

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same merges in n log n steps: a heap of pairs over a linked list."""
        get, n = self.merges.get, len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(v, i) for i in range(n - 1) if (v := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            v, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 20 | ids[j]) != v:
                continue
            ids[i], ids[j] = v & 0xFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n and (w := get(ids[a] << 20 | ids[b])) is not None:
                    heapq.heappush(heap, (w, a))
        return [x for x in ids if x >= 0]

    def encode_word(self, text: str) -> list[int]:
        word = text.encode()
        cuts = self.cuts(word)
        if not cuts:
            return self.merged(word, True)
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True):
            key = (word[a:b], b == len(word))
            if (ids := self.fragments.get(key)) is None:
                if len(self.fragments) >= MAX_CACHED:
                    self.fragments.clear()
                ids = self.fragments[key] = self.merged(*key)
            out += ids
        return out

    def __missing__(self, chunk: str) -> tuple[str, str]:
        text = chunk.lower() if chunk.isascii() else _normalizer().normalize_str(chunk)
        ids: list[int] = []
        for word in _word_pattern().findall(text):
            if (own := self.words.get(word)) is None:
                if len(self.words) >= MAX_CACHED:
                    self.words.clear()
                own = self.words[word] = self.encode_word(word)
            ids += own
        if len(self) >= MAX_CACHED:
            self.clear()
        self[chunk] = out = (" ".join(map(str, ids)), " ".join(map(self.tokens.__getitem__, ids)))
        return out

    def coded(self, text: str) -> tuple[str, str]:
        """The ids and the decoded text; this vocabulary decodes to its tokens joined by spaces."""
        out: list[tuple[str, str]] = []
        for k, part in enumerate(self.is_special.split(text)):
            if k % 2:
                out.append((str(self.special[part]), part))
            else:
                out += map(self.__getitem__, _SPACE.split(part) if _NOT_WHITE.search(part) else part.split())
        return " ".join([x[0] for x in out if x[0]]), " ".join([x[1] for x in out if x[0]])


@functools.lru_cache(maxsize=2)
def loaded(path: str | Callable[[], str]) -> WordBpe:
    """A path that is a function is asked for on the worker, whose files may lie elsewhere."""
    return WordBpe(path() if callable(path) else path)


#: What coding a text gives.
CODED = "n_tokens long, ids_sha256 string, decoded_sha256 string, token_ids array<int>"


def coded(docs: DataFrame, path: str | Callable[[], str]) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and token_ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            ids, digests, decoded = [], [], []
            for text in batch.column("text"):
                a, b = bpe.coded(text.as_py() or "")
                ids.append(np.fromstring(a, np.int32, sep=" ") if a else np.zeros(0, np.int32))
                digests.append(digest(a))
                decoded.append(digest(b))
            sizes = np.array([len(x) for x in ids], np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), lists],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {CODED}")


def encoded(docs: DataFrame, path: str | Callable[[], str]) -> DataFrame:
    """docs with token_ids, the ids of the text, in place of a column of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = [list(map(int, bpe.coded(t.as_py() or "")[0].split())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, "token_ids"]
            )

    schema = docs.drop("token_ids").schema.add("token_ids", ArrayType(IntegerType()))
    return docs.drop("token_ids").mapInArrow(run, schema)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"), vocabulary).drop("token_ids")


def bpe_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the digests and token_ids of each document."""
    return coded(docs, vocabulary)
