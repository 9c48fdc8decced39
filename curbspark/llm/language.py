"""Language identification: scripts narrow the candidates, Viterbi labels spans.

A word is a maximal run of letters (and of marks after them). Its script follows
from code point ranges; only languages that wrote at least MIN_SCRIPT_SHARE of
their training letters in that script are candidates (all, if none did). A
word's score for a language is the mean log likelihood of its character n-grams,
borders included, times its length. The best path over the words of a text, with
a penalty for every switch, labels each word; neighbouring words of one label
form a span. The document's language is the one with most letters (ties: first
by name), its score that language's share of the letters.

The model is n-gram counts by language, summed by Spark over about MAX_TRAINING
rows a language (taken by a hash of id and text, so whatever the order of rows)
of texts with a non-null lang. Beyond MAX_LANGUAGES languages, those with most
rows are learned. Its size is languages times BUCKETS counts.

A null text or one without a letter is `und` with score 0, and so is every text if
nothing can be learned. A null doc_id counts as empty text. Repeated rows count
and are labelled each by itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbspark.llm.common import table

#: Rows a language that the model is fitted on (expected number), and languages learned.
MAX_TRAINING = 20_000
MAX_LANGUAGES = 256
#: Hash buckets of the n-grams, and the lengths of n-grams.
BUCKETS = 1 << 16
LENGTHS = (1, 2, 3, 4)
#: Added to each count.
SMOOTHING = 0.5
#: Share of a language's training letters that makes it a candidate for words of a script.
MIN_SCRIPT_SHARE = 0.01
#: What a change of language costs, in units of log likelihood.
SWITCH_PENALTY = 12.0
UNDETERMINED = "und"
#: Code points that a worker scores at a time; a longer text is scored by itself.
CHUNK_POINTS = 1 << 20

#: First and last code point of the scripts told apart (fixed values of Unicode blocks); other letters are script 0.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("han", 0x20000, 0x323AF),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))

_U = np.uint64
_MIX, _LEAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: 1 for a letter and 2 for a mark, its lower-case form, its script."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for point in range(0x110000):
        letter = chr(point)
        category = unicodedata.category(letter)[0]
        if category == "L":
            kind[point] = 1
            small = letter.lower()
            lower[point] = ord(small) if len(small) == 1 else point
        elif category == "M":
            kind[point] = 2
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_NAMES.index(name)
    return kind, lower, script


class _Words:
    """The words of some texts: start and end in code points of the texts laid end to end, text, script, and the
    different words with their n-grams."""

    def __init__(self, texts: list[str]):
        kind_of, lower_of, script_of = _tables()
        data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        kind = kind_of[data]
        border = np.zeros(len(data) + 1, bool)
        border[self.offsets] = True
        inside = kind > 0
        # A mark counts only behind a letter or mark of its word.
        starts = np.flatnonzero((kind == 1) & (np.concatenate(([True], ~inside[:-1])) | border[:-1]))
        if len(data):
            ends = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | border[1:])) + 1
            # Runs that open with marks: their word starts at the first letter.
            opened = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | border[:-1]))
            marks = kind[opened] == 2
            if marks.any():
                letters = np.append(np.flatnonzero(kind == 1), len(data))
                first = letters[np.searchsorted(letters, opened)]
                keep = first < ends
                starts, ends = first[keep], ends[keep]
        else:
            ends = starts
        self.starts, self.ends = starts, ends
        self.text = np.searchsorted(self.offsets, starts, "right") - 1
        self.first = np.searchsorted(starts, self.offsets)
        self.script = script_of[data[starts]] if len(starts) else np.zeros(0, np.uint8)
        self._lower = lower_of[data] if len(data) else data
        self._distinct()

    def _distinct(self) -> None:
        """Different words by a 64-bit hash: one place of each, and for every word the number of its kind."""
        if not len(self.starts):
            self.one, self.kind = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        with np.errstate(over="ignore"):
            mixed = self._lower.astype(_U) * _U(_MIX)
            mixed = (mixed ^ (mixed >> _U(29))) * _U(_LEAD)
            powers = np.full(len(mixed), _MIX | 1, _U)
            powers[0] = 1
            powers = np.cumprod(powers, dtype=_U)
            back = np.full(len(mixed), pow(_MIX | 1, -1, 1 << 64), _U)
            back[0] = 1
            back = np.cumprod(back, dtype=_U)
            sums = np.concatenate((np.zeros(1, _U), np.cumsum(mixed * powers, dtype=_U)))
            key = (sums[self.ends] - sums[self.starts]) * back[self.starts]
        _, self.one, self.kind = np.unique(key, return_index=True, return_inverse=True)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of every n-gram of the different words, and how many each word has."""
        length = self.ends[self.one] - self.starts[self.one]
        # Words laid end to end with one border before each and one behind the last.
        places = np.concatenate(([0], np.cumsum(length + 1)))
        letters = np.full(places[-1] + 1, 0x20, _U)
        within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        letters[np.repeat(places[:-1] + 1, length) + within] = self._lower[np.repeat(self.starts[self.one], length) + within]
        word = np.repeat(np.arange(len(length)), length + 1)
        offset = np.arange(places[-1]) - places[word]
        buckets, owners = [], []
        with np.errstate(over="ignore"):
            rolled = np.zeros(len(letters), _U)
            for n in range(1, max(LENGTHS) + 1):
                rolled = rolled[: len(letters) - n + 1] * _U(_LEAD) + letters[n - 1 :] + _U(1)
                if n in LENGTHS:
                    # With both borders a word has length + 2 places; the last border is the next word's first.
                    at = np.flatnonzero((offset + n <= length[word] + 2)[: len(rolled)] & ((n > 1) | (offset > 0)[: len(rolled)]))
                    mixed = (rolled[at] + _U(n)) * _U(_MIX)
                    buckets.append(((mixed ^ (mixed >> _U(31))) * _U(_LEAD) >> _U(48)).astype(np.int64) % BUCKETS)
                    owners.append(word[at])
        bucket, owner = np.concatenate(buckets), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return bucket[order], np.bincount(owner, minlength=len(length))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of about CHUNK_POINTS code points, with the number of the first."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        if k > begin and held + len(text or "") > CHUNK_POINTS:
            yield begin, [t or "" for t in texts[begin:k]]
            begin, held = k, 0
        held += len(text or "")
    if begin < len(texts):
        yield begin, [t or "" for t in texts[begin:]]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n of a partition's batches; scripts as negative buckets."""
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for begin, part in _chunks(texts):
            words = _Words(part)
            if not len(words.starts):
                continue
            names = sorted(set(langs[begin : begin + len(part)]))
            number = np.array([names.index(x) for x in langs[begin : begin + len(part)]])[words.text]
            bucket, held = words.grams()
            first = np.concatenate(([0], np.cumsum(held)))[:-1]
            for k, name in enumerate(names):
                times = np.bincount(words.kind[number == k], minlength=len(words.one))
                grams = np.bincount(bucket, np.repeat(times, held), BUCKETS) if len(first) else np.zeros(BUCKETS)
                at = np.flatnonzero(grams)
                letters = np.bincount(
                    words.script[number == k], (words.ends - words.starts)[number == k], len(SCRIPT_NAMES)
                )
                written = np.flatnonzero(letters)
                yield pa.record_batch(
                    [
                        pa.array([name] * (len(at) + len(written)), pa.string()),
                        pa.array(np.concatenate((at, -1 - written)), pa.int64()),
                        pa.array(np.concatenate((grams[at], letters[written])).astype(np.int64)),
                    ],
                    names=["lang", "bucket", "n"],
                )


def training_rows(docs: DataFrame) -> DataFrame:
    """lang, text: about MAX_TRAINING rows a language of docs (doc_id, text, lang)."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One row a language: the only list of languages that reaches one place, and it is cut to MAX_LANGUAGES.
    counts = usable.groupBy("lang").agg(F.count("*").alias("_rows")).orderBy(F.desc("_rows"), "lang").limit(MAX_LANGUAGES)
    place = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(1 << 30))
    return (
        usable.join(F.broadcast(counts), "lang")
        .where(place * F.col("_rows") < F.lit(MAX_TRAINING * (1 << 30)))
        .select("lang", "text")
    )


class Model:
    """Languages by name, log likelihoods [bucket, language], and the languages that use a script [script, language]."""

    def __init__(self, rows: DataFrame):
        counted = (
            rows.mapInArrow(_count_grams, "lang string, bucket long, n long")
            .groupBy("lang", "bucket")
            .agg(F.sum("n").alias("n"))
            .toPandas()
        )
        self.names = sorted(counted["lang"].unique())
        number = {name: k for k, name in enumerate(self.names)}
        grams = np.zeros((BUCKETS, len(self.names)))
        letters = np.zeros((len(SCRIPT_NAMES), len(self.names)))
        language = counted["lang"].map(number).to_numpy(dtype=np.int64)
        bucket, n = counted["bucket"].to_numpy(), counted["n"].to_numpy()
        at = bucket >= 0
        grams[bucket[at], language[at]] = n[at]
        letters[-1 - bucket[~at], language[~at]] = n[~at]
        self.likelihoods = np.log((grams + SMOOTHING) / (grams.sum(0) + SMOOTHING * BUCKETS)).astype(np.float32)
        self.uses = letters >= MIN_SCRIPT_SHARE * letters.sum(0)
        self.uses[~self.uses.any(1)] = True


def _paths(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best label of every word. Text t has the words first[t] to first[t + 1]; all texts go on together,
    word by word, the longest first, so that the ones that are left are always the leading ones."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    begin, counts = first[:-1][order], counts[order]
    labels = np.zeros(len(scores), np.int32)
    came = np.zeros(scores.shape, np.int16)
    total = np.zeros((len(order), scores.shape[1]), np.float64)
    last = np.arange(scores.shape[1], dtype=np.int16)
    for k in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -k, "left"))
        at, so_far = begin[:live] + k, total[:live]
        if k:
            best = so_far.argmax(1)
            moved = so_far[np.arange(live), best] - SWITCH_PENALTY
            stay = so_far >= moved[:, None]
            came[at] = np.where(stay, last, best[:, None])
            so_far = np.where(stay, so_far, moved[:, None])
        total[:live] = so_far + scores[at]
    label = total.argmax(1)
    for k in range(int(counts[0]) - 1 if len(counts) else -1, -1, -1):
        live = int(np.searchsorted(-counts, -k, "left"))
        at = begin[:live] + k
        labels[at] = label[:live]
        label[:live] = came[at, label[:live]]
    return labels


#: Spans in code points of the text, end exclusive, and how many letters and marks their words have.
SPANS = "array<struct<start:long,end:long,lang:string,letters:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("letters", pa.int64())]))


def _labelled(names: list[str], likelihoods: np.ndarray, uses: np.ndarray, texts: list[str]) -> pa.Array:
    words = _Words(texts)
    if not len(words.starts) or not names:
        return pa.array([[] for _ in texts], _SPANS)
    bucket, held = words.grams()
    begin = np.concatenate(([0], np.cumsum(held)))
    summed = np.empty((len(held), len(names)))
    # Whole words at a time, so that the gathered rows stay bounded.
    step = max(1, (1 << 22) // len(names))
    a = 0
    while a < len(held):
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + step, "right")) - 1)
        summed[a:b] = np.add.reduceat(likelihoods[bucket[begin[a] : begin[b]]], begin[a:b] - begin[a], axis=0)
        a = b
    length = (words.ends - words.starts)[words.one]
    summed *= (length / held)[:, None]
    scores = np.where(uses[words.script], summed[words.kind], -1e9)
    # Among the candidates only differences matter.
    scores -= scores.max(1, keepdims=True)
    np.maximum(scores, -1e6, out=scores)
    labels = _paths(scores, words.first)
    opens = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (words.text[1:] != words.text[:-1]))))
    closes = np.append(opens[1:], len(labels))
    text = words.text[opens]
    sizes = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
    spans = pa.StructArray.from_arrays(
        [
            pa.array(words.starts[opens] - words.offsets[text]),
            pa.array(words.ends[closes - 1] - words.offsets[text]),
            pa.array(np.array(names, object)[labels[opens]], pa.string()),
            pa.array(sizes[closes] - sizes[opens]),
        ],
        fields=list(_SPANS.value_type),
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), spans)


def labelled_spans(docs: DataFrame, model: Model) -> DataFrame:
    """docs with language_spans: where each language stands in the text. Replaces no column but one of that name."""
    names, likelihoods, uses = model.names, model.likelihoods, model.uses
    keep = [c for c in docs.columns if c != "language_spans"]
    schema = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL(f"language_spans {SPANS}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, part in _chunks(batch.column("text").to_pylist()):
                rows = batch.slice(begin, len(part))
                yield pa.record_batch(
                    [*rows.columns, _labelled(names, likelihoods, uses, part)], names=[*keep, "language_spans"]
                )

    return docs.select(*(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)


def predicted(labelled: DataFrame) -> DataFrame:
    """labelled with lang_pred and score of its language_spans."""
    letters = F.aggregate("language_spans", F.lit(0).cast("long"), lambda n, s: n + s["letters"])
    named = F.array_distinct(F.transform("language_spans", lambda s: s["lang"]))
    of = lambda name: F.aggregate(
        "language_spans", F.lit(0).cast("long"), lambda n, s: n + F.when(s["lang"] == name, s["letters"]).otherwise(0)
    )
    shares = F.transform(named, lambda name: F.struct((-of(name)).alias("n"), name.alias("lang")))
    best = F.array_min(shares)
    return labelled.withColumns(
        {
            "lang_pred": F.coalesce(best["lang"], F.lit(UNDETERMINED)),
            "score": F.coalesce(F.try_divide(-best["n"], letters), F.lit(0.0)),
        }
    )


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    model = Model(training_rows(docs.where(remainder != 1)))
    inputs = docs.select("doc_id", (remainder == 1).alias("held_out"), "text")
    return predicted(labelled_spans(inputs, model)).select("doc_id", "held_out", "lang_pred", "score", "language_spans")
