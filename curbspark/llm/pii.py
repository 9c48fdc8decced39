r"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select.

For each kind there is a strict expression, whose matches stand if they pass the
kind's check, and a loose one of high recall, whose matches may overlap anything.
Loose matches carry features of their format and context, none of which tells
whether the strict expression matches. Boosted trees learn from standing spans
rewritten as people write them to keep programs away (words for signs, other
separators, no leading plus) against spoiled spans (wrong check digits, numbers
above 255, no domain ending, bare runs of digits), spans taken for another kind, and
loose matches that fail their kind's check whatever the separators. Each kind's threshold is the least that
keeps the wanted precision on examples held out from training. Loose matches above
it that overlap no standing span are added. The trees are evaluated as plain column
expressions.

Positions are code points, end exclusive: pieces between matches and matches,
summed up. The strict expressions begin at a match's end or where no character of
their first run stands before, which finds the same leftmost matches in linear time; repeated groups are possessive, so that long runs need no stack.

Null and empty texts have no span. Repeated rows give a row each. With too few
candidates of either label nothing is added. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbspark.llm.common import staged, table, whole_text

KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Generator:
    #: A text without a match of this holds no loose match and no strict one that stands.
    hint: str
    strict: str
    loose: str


GENERATORS = {
    "email": Generator(
        r"@|[\[(]at[\])]",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        r"(?:\G|(?<![\w.%+-]))[\w.%+-]++ ?(?:@|[\[(]at[\])]) ?[\w-]++(?: ?(?:\.|[\[(]dot[\])]) ?[\w-]++)*+",
    ),
    "ip": Generator(
        r"[0-9][.,:_-][0-9]",
        r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
        r"(?:\G|(?<![0-9]))[0-9]++(?:[.,:_-][0-9]++){3,}+",
    ),
    "card": Generator(
        r"[0-9](?:[\x20./_-]{0,2}[0-9]){11}",
        r"[0-9](?:[\x20-]?[0-9])++",
        r"[0-9](?:[\x20./_-]{0,2}[0-9]){11,}+",
    ),
    "phone": Generator(
        r"[0-9][\x20()./0-9-]{4,}[0-9]",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"(?:\+|\b00|\()?[0-9][\x20()./0-9-]{5,}[0-9]",
    ),
}
#: Words before a match that tell of its kind, in the languages of the corpus.
CUES = {
    "email": r"mail|contact|kontakt|correo|courriel|write|schreib",
    "ip": r"\bip\b|host|server|address|adresse",
    "card": r"card|karte|carte|tarjeta|visa|pay|zahl",
    "phone": r"phone|tel|call|fax|ruf|llam|appel|mobil",
}
CONTEXT_CHARS = 24
#: Most different examples of each kind of row for a trial run; None, which every query uses, takes all of them.
MAX_TRAINING: int | None = None
TREES, DEPTH = 20, 3
#: Precision on held-out candidates that a threshold has to keep.
PRECISION = 0.98
#: Least number of candidates of each label.
MIN_EXAMPLES = 20

FEATURES = (
    "f_kind", "f_chars", "f_digits", "f_groups", "f_longest", "f_first", "f_last", "f_at_word", "f_dots", "f_spaces",
    "f_parentheses", "f_luhn", "f_octets", "f_tld", "f_letter_before", "f_letter_after", "f_digit_near", "f_cue",
)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def stands(kind: Column, match: Column) -> Column:
    """The checks of the strict matches."""
    digits = digits_of(match)
    count = F.length(digits)
    part = lambda k: F.regexp_replace(F.split_part(match, F.lit("."), F.lit(k)), "^0+(?=.)", "")
    octets = F.lit(True)
    for k in range(1, 5):
        p = part(k)
        octets = octets & (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", octets)
        .when(kind == "card", count.between(13, 19) & F.call_function("luhn_check", digits))
        .otherwise(count.between(9, 15))
    )


def matches(docs: DataFrame) -> DataFrame:
    """_row, doc_id, kind, strict, match, start, end, before, after: a row for each match, and for each document
    without any a row whose kind is null. _row tells rows with equal ids apart."""
    found = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", whole_text().alias("_text"))
    arrays = []
    for kind, g in GENERATORS.items():
        found = found.withColumn(f"_has_{kind}", F.col("_text").rlike(g.hint))
    columns = {}
    for kind, g in GENERATORS.items():
        for name, pattern in (("strict", g.strict), ("loose", g.loose)):
            has = F.col(f"_has_{kind}")
            columns[f"_{kind}_{name}_m"] = F.when(has, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
            columns[f"_{kind}_{name}_p"] = F.when(has, F.split("_text", pattern, -1))
            arrays.append((kind, name))
    found = found.withColumns(columns)

    def listed(kind: str, name: str) -> Column:
        m, p = f"_{kind}_{name}_m", f"_{kind}_{name}_p"
        zipped = F.arrays_zip(
            F.col(m).alias("m"), F.expr(f"slice({p}, 1, size({m}))").alias("b"), F.expr(f"slice({p}, 2, size({m}))").alias("a")
        )
        return F.coalesce(
            F.transform(
                zipped,
                lambda z, i: F.struct(
                    F.lit(kind).alias("kind"),
                    F.lit(name == "strict").alias("strict"),
                    i.alias("at"),
                    z.m.alias("match"),
                    F.length(z.b).alias("gap"),
                    F.substring(z.b, -CONTEXT_CHARS, CONTEXT_CHARS).alias("before"),
                    F.substring(z.a, 1, CONTEXT_CHARS).alias("after"),
                ),
            ),
            F.expr(
                "cast(array() as array<struct<kind:string,strict:boolean,at:int,match:string,gap:int,before:string,after:string>>)"
            ),
        )

    rows = found.select(
        "_row",
        "doc_id",
        F.explode_outer(F.concat(*(listed(*x) for x in arrays))).alias("m"),
    ).select("_row", "doc_id", "m.*")
    order = Window.partitionBy("_row", "kind", "strict").orderBy("at")
    return (
        rows.repartition("_row")
        .withColumn("end", F.sum(F.col("gap") + F.length("match")).over(order))
        .withColumn("start", F.col("end") - F.length("match"))
        .drop("gap", "at")
    )


def features(kind: str, match: str, before: str, after: str) -> dict[str, Column]:
    """Format and context of a span. None tells whether the strict expression of its kind matches."""
    m, low = F.col(match), F.lower(before)
    digits = digits_of(m)
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    cue, kind_number = F.lit(False), F.lit(0.0)
    for k, (name, words) in enumerate(CUES.items(), 1):
        cue = cue | ((F.col(kind) == name) & low.rlike(words))
        kind_number = F.when(F.col(kind) == name, F.lit(float(k))).otherwise(kind_number)
    out = {
        "f_kind": kind_number,
        "f_chars": F.length(m).cast("double"),
        "f_digits": F.length(digits).cast("double"),
        "f_groups": F.regexp_count(m, F.lit("[0-9]+")).cast("double"),
        "f_longest": F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), F.length)).cast("double"),
        "f_first": F.length(F.regexp_extract(m, "[0-9]+", 0)).cast("double"),
        "f_last": F.length(F.regexp_extract(m, "[0-9]+$", 0)).cast("double"),
        "f_at_word": number(m.rlike(r"[\[(]at[\])]")),
        "f_dots": F.regexp_count(m, F.lit(r"\.")).cast("double"),
        "f_spaces": F.regexp_count(m, F.lit(" ")).cast("double"),
        "f_parentheses": F.regexp_count(m, F.lit("[()]")).cast("double"),
        "f_luhn": number((F.length(digits) > 0) & F.call_function("luhn_check", digits)),
        "f_octets": number(m.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[.,:_-]|$)){4}$")),
        "f_tld": number(m.rlike(r"(?:\.|dot[\])]) ?[A-Za-z]{2,6}$")),
        "f_letter_before": number(F.col(before).rlike(r"\p{L}$")),
        "f_letter_after": number(F.col(after).rlike(r"^\p{L}")),
        "f_digit_near": number(F.col(before).rlike(r"[0-9].?$") | F.col(after).rlike("^.?[0-9]")),
        "f_cue": number(cue),
    }
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()}


def _grouped(digits: Column, between: Column) -> Column:
    return F.call_function("array_join", F.regexp_extract_all(digits, F.lit("[0-9]{1,4}"), F.lit(0)), between)


def rewritten(kind: Column, match: Column, way: Column) -> Column:
    """A strict match as it is written to escape the strict expression; way is 0 to 3."""
    digits, by = digits_of(match), lambda *x: F.get(F.array(*x), way)
    local, domain = F.split_part(match, F.lit("@"), F.lit(1)), F.split_part(match, F.lit("@"), F.lit(2))
    at = by(*map(F.lit, (" [at] ", "(at)", "[at]", " @ ")))
    dot = by(*map(F.lit, (" [dot] ", ".", "[dot]", " . ")))
    ten = F.right(digits, F.lit(10))
    area, middle, last = F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4)
    return (
        F.when(kind == "email", F.concat(local, at, F.replace(domain, F.lit("."), dot)))
        .when(kind == "ip", F.replace(match, F.lit("."), by(*map(F.lit, (",", "-", "_", ":")))))
        .when(kind == "card", _grouped(digits, by(*map(F.lit, (".", "/", "  ", "_")))))
        .otherwise(
            by(
                F.concat(F.lit("("), area, F.lit(") "), middle, F.lit("-"), last),
                F.concat_ws("-", area, middle, last),
                F.concat_ws(".", area, middle, last),
                F.concat_ws(" ", F.concat(F.lit("001"), area), middle, last),
            )
        )
    )


def spoiled(kind: Column, match: Column) -> Column:
    """A strict match changed into what is no personal data: no domain ending, a wrong check digit, a number above
    255, a run of digits."""
    digits = digits_of(match)
    part = F.split_part(match, F.lit("."), F.lit(1))
    return (
        F.when(kind == "email", F.regexp_replace(match, "@([^.]*).*$", "@$1"))
        .when(kind == "ip", F.concat((F.coalesce(part.try_cast("int"), F.lit(0)) + 300).cast("string"), F.substr(match, F.length(part) + 1)))
        .when(kind == "card", F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), ((F.right(digits, F.lit(1)).cast("int") + 1) % 10).cast("string")))
        .otherwise(F.right(digits, F.lit(10)))
    )


def plausible() -> Column:
    """Whether a candidate's features pass its kind's check if separators do not count: its label is not known."""
    kind, digits = F.col("kind"), F.col("f_digits")
    return (
        F.when(kind == "email", F.col("f_tld") == 1)
        .when(kind == "ip", F.col("f_octets") == 1)
        .when(kind == "card", digits.between(13, 19) & (F.col("f_luhn") == 1))
        .otherwise(digits.between(9, 15) & (F.col("f_groups") > 1))
    )


def _learned(different: DataFrame, *order: str) -> DataFrame:
    return different if MAX_TRAINING is None else different.orderBy(*order).limit(MAX_TRAINING // 4)


def examples(rows: DataFrame) -> DataFrame:
    """kind, label, _pick and features of all examples, in an order that does not depend on the run.

    Strict matches that stand are rewritten in the ways of the loose expressions (label 1), spoiled and then
    rewritten, and taken for another kind (label 0). With them go loose matches that overlap no standing one
    and fail the check of their kind whatever the separators (label 0). Copies of a passage count once.
    """
    context = ("before", "after", "_pick")
    strict = _learned(rows.where("standing").select("kind", "match", *context).distinct(), "_pick", "kind", "match", "before")
    kind, match = F.col("kind"), F.col("match")
    # A place in the text that is not the one the split into training and held-out rows takes.
    way = F.pmod(F.shiftright("_pick", 8), F.lit(4)).cast("int")
    other = F.when(kind == "card", "phone").when(kind == "phone", "card").otherwise("phone")
    digits_only = (kind == "ip") | (kind == "phone") | (kind == "card")
    made = strict.select(
        *context,
        F.explode(
            F.array(
                F.struct(kind.alias("kind"), rewritten(kind, match, way).alias("match"), F.lit(1.0).alias("label")),
                F.struct(kind.alias("kind"), F.when(kind == "phone", spoiled(kind, match)).otherwise(rewritten(kind, spoiled(kind, match), way)).alias("match"), F.lit(0.0).alias("label")),
                F.struct(F.when(digits_only, other).alias("kind"), rewritten(kind, match, way).alias("match"), F.lit(0.0).alias("label")),
            )
        ).alias("_made"),
    )
    # Written first, so that the features do not repeat the rewriting in one expression.
    made = staged(made.select(*context, "_made.*").where("kind IS NOT NULL AND match IS NOT NULL"), "pii")
    made = made.withColumns(features("kind", "match", "before", "after")).select("kind", "label", "_pick", *FEATURES)
    failed = rows.where("loose AND NOT any_hit").where(~plausible()).select("kind", F.lit(0.0).alias("label"), "_pick", *FEATURES)
    found = _learned(failed.distinct(), "_pick", *FEATURES)
    return made.unionByName(found).repartition("_pick").sortWithinPartitions("_pick", "kind", "label", *FEATURES)


def candidates(docs: DataFrame) -> DataFrame:
    """Standing strict matches and loose ones with features; hit: overlaps a standing one of its kind, any_hit: of any."""
    passed = ~F.col("strict") | stands(F.col("kind"), F.col("match"))
    rows = matches(docs).withColumn("_ok", F.coalesce(passed, F.lit(True)))
    # A failed strict match leaves a row, so that each document keeps one.
    standing = F.col("strict") & F.col("_ok")

    def overlaps(*keys: str) -> Column:
        earlier = Window.partitionBy(*keys).orderBy("start", F.col("end").desc())
        later = Window.partitionBy(*keys).orderBy(F.col("start").desc(), "end")
        return F.coalesce(F.max(F.when(standing, F.col("end"))).over(earlier) > F.col("start"), F.lit(False)) | F.coalesce(
            F.min(F.when(standing, F.col("start"))).over(later) < F.col("end"), F.lit(False)
        )

    return (
        rows.withColumns({"hit": overlaps("_row", "kind"), "any_hit": overlaps("_row")})
        .withColumns(features("kind", "match", "before", "after"))
        .withColumn("_pick", F.xxhash64("before", "match", "after"))
        .withColumn("standing", F.coalesce(standing, F.lit(False)))
        .withColumn("loose", F.coalesce(~F.col("strict"), F.lit(False)))
        .drop("strict", "_ok")
    )


def _tree(node, features: tuple[str, ...]) -> Column:
    """A regression tree as a column expression."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(
        F.col(features[split.featureIndex()]) <= F.lit(float(split.threshold())), _tree(node.leftChild(), features)
    ).otherwise(_tree(node.rightChild(), features))


def trained(rows: DataFrame) -> tuple[Column, dict[str, float]] | None:
    """The score of a candidate as an expression, and the threshold of each kind."""
    sample = staged(examples(rows), "pii")
    labels = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if min(labels.get(0.0, 0), labels.get(1.0, 0)) < MIN_EXAMPLES:
        return None
    training = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        sample.where(F.pmod("_pick", F.lit(5)) != 0)
    )
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=11, cacheNodeIds=False).fit(training)
    raw = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        raw = raw + F.lit(float(weight)) * _tree(tree._call_java("rootNode"), FEATURES)
    score = 1 / (1 + F.exp(-2 * raw))
    # At most 100 rows for each kind reach the driver.
    steps = (
        sample.where(F.pmod("_pick", F.lit(5)) == 0)
        .groupBy("kind", F.floor(100 * score).alias("step"))
        .agg(F.sum("label").alias("right"), F.count("*").alias("n"))
        .collect()
    )
    thresholds = {}
    for kind in KINDS:
        right = n = 0
        own = sorted((r for r in steps if r.kind == kind), key=lambda r: -r.step)
        for k, r in enumerate(own, 1):
            right, n = right + r.right, n + r.n
            if right >= PRECISION * n:
                # Halfway to the next scores below, where examples of the other label begin.
                thresholds[kind] = (r.step + (own[k].step if k < len(own) else r.step)) / 200
    return score, thresholds


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the standing spans, their digest, and all spans."""
    rows = staged(candidates(docs), "pii")
    added = F.lit(False)
    if model := trained(rows):
        score, thresholds = model
        for kind, least in thresholds.items():
            added = added | ((F.col("kind") == kind) & (score >= least))
    rows = rows.withColumn("added", F.coalesce(F.col("loose") & ~F.col("any_hit") & added, F.lit(False)))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct(place.alias("place"), "start", "end", "kind")
    written = lambda x: F.array_join(
        F.transform(F.sort_array(x), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ","
    )
    return (
        rows.groupBy("_row", "doc_id")
        .agg(
            *(F.sum(F.when(F.col("standing") & (F.col("kind") == k), 1).otherwise(0)).alias(f"n_{k}") for k in KINDS),
            F.collect_list(F.when(F.col("standing"), span)).alias("_base"),
            F.collect_set(F.when(F.col("standing") | F.col("added"), span)).alias("_all"),
        )
        .select(
            "doc_id",
            *(f"n_{k}" for k in KINDS),
            F.sha2(written("_base"), 256).alias("base_sha256"),
            written("_all").alias("spans"),
        )
    )


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
