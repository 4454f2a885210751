"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: kind, pattern, least length of group, that group, and a cheaper test that every text with a match passes.
BASE = (
    ("assign", _ASSIGN, 12, 1, r"(?i)(?:passw|secret|token|api_?key)[a-z]*[\"']?\x20*[:=]"),
    ("access", r"AKIA[A-Z0-9]+", 18, 0, r"AKIA[A-Z0-9]{14}"),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 16, 0, r"[0-9a-f]{16}"),
)
_CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Running totals go over blocks of so many matches, and over blocks of the blocks' totals, as an array grows by copying.
_RUN = 128
#: Mean log-likelihood ratio of a transition, in nats, from which a candidate counts as random.
THRESHOLD = 0.9
#: Labelled samples the models are trained on: this many random strings and identifiers.
SAMPLES = 2000
_WORDS = (
    "get set user name value data file path list item index count total size key map node edge graph table column row cell page view model "
    "config option setting default current previous next first last start end begin finish create update delete remove insert select "
    "query result response request handler manager service client server session connection socket buffer stream reader writer parser "
    "format string number integer float double boolean array object class method function parameter argument return error exception "
    "message event listener callback thread process queue worker task job schedule timer date time zone hour minute second year month "
    "account customer order product price amount invoice payment address street city country phone email image video audio document "
    "internal external public private static abstract generic template builder factory provider adapter controller repository "
    "application environment production development version release build test debug trace logger level info warning cache memory disk "
    "the and for with from that this have which their about other would there because between through should people after government "
    "information different international development university education environment performance organization management"
).split()


def _samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(random boolean, text): labelled strings, made by fixed rules so that every run trains the same models."""
    ids = spark.range(n, numPartitions=1)
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    base64 = F.substring(F.base64(F.unhex(digest)), 1, 40)
    kinds = [base64, F.translate(base64, "+/", "-_"), F.regexp_replace(base64, "[+/=]", "x"), F.upper(F.substring(F.md5(digest), 1, 32)), F.md5(digest)]
    shape = F.col("id") % 7
    random_ = ids.select(F.lit(True).alias("random"), F.when(shape < 3, kinds[0]).when(shape == 3, kinds[1]).when(shape == 4, kinds[2]).when(shape == 5, kinds[3]).otherwise(kinds[4]).alias("text"))
    words = F.array(*map(F.lit, _WORDS))
    part = [F.element_at(words, (F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(len(_WORDS))) + 1).cast("int")) for i in range(5)]
    snake, camel = F.concat_ws("_", *part[:4]), F.concat(part[0], *(F.initcap(p) for p in part[1:4]))
    number = F.concat(F.concat_ws("-", *part[:3]), F.lit("-"), F.pmod(F.xxhash64("id"), F.lit(10000)).cast("string"))
    names = [snake, camel, F.concat_ws("/", *part[:4]), F.upper(snake), number, F.concat(*part), F.concat_ws("-", *part[:4])]
    choice = names[0]
    for i, c in enumerate(names):
        choice = F.when(shape == i, c).otherwise(choice)
    return random_.unionByName(ids.select(F.lit(False).alias("random"), choice.alias("text")))


def train_markov(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition between letters of ALPHABET, random over ordinary, in hundredths of a nat.

    labelled has (random boolean, text); transitions are counted for each label with one added to each. Nulls are left out.
    The result has len(ALPHABET) squared numbers whatever the sample's size.
    """
    n = len(ALPHABET)
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("text") - 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(2)))
    pairs = labelled.where("text is not null and random is not null").select("random", F.explode(places).alias("pair")).where(F.char_length("pair") == 2)
    counted = {(r.random, r.pair): r.n for r in pairs.where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    tables = {}
    for label in (True, False):
        after = {a: sum(counted.get((label, a + b), 0) for b in ALPHABET) for a in ALPHABET}
        tables[label] = [math.log((counted.get((label, a + b), 0) + 0.5) / (after[a] + 0.5 * n)) for a in ALPHABET for b in ALPHABET]
    return [round(100 * (x - y)) for x, y in zip(tables[True], tables[False], strict=True)]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _running(values: Column, zero: Column, join: Callable[[Column, Column], Column], depth: int = 1) -> Column:
    """The totals of an array up to each place, itself included, under an associative join.

    Inside blocks of _RUN values each place sums its block up to it; what stands before a block is a running total of the
    blocks' totals, made alike. So a place costs some steps, however long the array is.
    """

    def fold(part: Column) -> Column:
        return F.aggregate(part, zero, join)

    def inside(own: Column, base: Column) -> Column:
        return F.transform(own, lambda _, i: join(base, fold(F.slice(own, F.lit(1), i + 1))))

    if not depth:
        return inside(values, zero)

    def spread(blocks: Column) -> Column:
        before = _running(F.transform(blocks, fold), zero, join, depth - 1)
        return _let(before, lambda t: F.flatten(F.transform(blocks, lambda own, b: inside(own, F.when(b > 0, F.get(t, b - 1)).otherwise(zero)))))

    last = F.floor((F.size(values) - 1) / _RUN).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: F.slice(values, b * _RUN + 1, F.lit(_RUN)))
    return _let(cut, spread)


def _starts(pieces: Column, found: Column) -> Column:
    """Start of each match, from the lengths of what split() leaves between matches and of the matches."""
    steps = F.transform(found, lambda m, i: F.char_length(F.get(pieces, i)) + F.when(i > 0, F.char_length(F.get(found, i - 1))).otherwise(0))
    return _let(steps, lambda st: _running(st, F.lit(0), lambda a, x: a + x))


_SPAN = "array<struct<start:int,kind:int,end:int,score:double>>"
KINDS = [*(b[0] for b in BASE), "markov"]


def _none() -> Column:
    return F.array().cast(_SPAN)


def _span(start: Column, kind: int, word: Column, score: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), (start + F.char_length(word)).cast("int").alias("end"), score.alias("score"))


def _base_spans(text: Column, kind: int) -> Column:
    _, pattern, least, group, test = BASE[kind]

    def spans(b: Column) -> Column:
        joined = F.zip_with(_starts(b["pieces"], b["found"]), F.arrays_zip(b["found"].alias("found"), b["values"].alias("values")), lambda s, x: F.struct(s.alias("s"), x.alias("x")))
        long = F.filter(joined, lambda j: F.char_length(j["x"]["values"]) >= least)
        return F.when(F.size(b["found"]) > 0, F.transform(long, lambda j: _span(j["s"], kind, j["x"]["found"], F.lit(0.0))).cast(_SPAN)).otherwise(_none())

    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"))
    return F.when(text.rlike(test), _let(parts, spans)).otherwise(_none())


def _score(word: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a word's transitions."""
    n = len(ALPHABET)
    place = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.instr(F.lit(ALPHABET), F.substring(word, i, F.lit(1))))
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, x: F.struct(x.alias("last"), F.when(a["last"] == 0, F.lit(0.0)).otherwise(a["sum"] + F.element_at(table, (a["last"] - 1) * n + x)).alias("sum"))
    return F.aggregate(place, start, step, lambda a: a["sum"] / (F.lit(100.0) * (F.char_length(word) - 1)))


def _free(spans: Column, base: Column) -> Column:
    """The spans that touch none of the base spans: all are put in one order, and each span is held against the furthest end
    before it and the next start after it."""
    marked = F.array_sort(F.concat(F.transform(base, lambda x: F.struct(x.alias("x"), F.lit(True).alias("base"))), F.transform(spans, lambda x: F.struct(x.alias("x"), F.lit(False).alias("base")))))

    def apart(rows: Column) -> Column:
        ends = _running(F.transform(rows, lambda r: F.when(r["base"], r["x"]["end"]).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x))
        starts = _running(F.reverse(F.transform(rows, lambda r: F.when(r["base"], r["x"]["start"]).otherwise(_FAR))), F.lit(_FAR), lambda a, x: F.least(a, x))
        joined = F.arrays_zip(rows.alias("r"), ends.alias("before"), F.reverse(starts).alias("after"))
        kept = F.filter(joined, lambda j: ~j["r"]["base"] & (j["before"] <= j["r"]["x"]["start"]) & (j["after"] >= j["r"]["x"]["end"]))
        return F.transform(kept, lambda j: j["r"]["x"])

    return F.when((F.size(base) == 0) | (F.size(spans) == 0), spans).otherwise(_let(marked, apart))


_FAR = (1 << 31) - 1


def _random_spans(text: Column, base: Column, table: Column, threshold: float) -> Column:
    def spans(b: Column) -> Column:
        both = F.zip_with(_starts(b["pieces"], b["found"]), b["found"], lambda s, w: F.struct(s.alias("s"), w.alias("w")))
        likely = F.filter(both, lambda x: x["w"].rlike("[0-9]") & x["w"].rlike("[A-Za-z]"))
        scored = F.transform(likely, lambda x: _span(x["s"], len(BASE), x["w"], _score(x["w"], table)))
        random_ = F.filter(scored, lambda x: x["score"] > threshold).cast(_SPAN)
        return F.when(F.size(b["found"]) > 0, _let(random_, lambda r: _free(r, base))).otherwise(_none())

    parts = F.struct(F.split(text, _CANDIDATE, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(_CANDIDATE), F.lit(0)).alias("found"))
    return F.when(text.rlike(r"[A-Za-z0-9+/_=-]{20}"), _let(parts, spans)).otherwise(_none())


def secret_spans(text: Column, model: list[float], threshold: float = THRESHOLD) -> Column:
    """Array of (start, kind, end, score) by start, then kind; code points, end exclusive; kind is a place in KINDS.

    Base spans come from the patterns alone. A candidate of 20 or more letters of ALPHABET, a digit and a letter among them,
    adds a span of kind markov where its mean log-likelihood ratio exceeds the threshold and no base span touches it.
    A null text is empty and has no spans.
    """
    text = F.coalesce(text, F.lit(""))
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    base = F.array_sort(F.concat(*(_base_spans(text, k) for k in range(len(BASE)))))
    return _let(base, lambda b: F.array_sort(F.concat(b, _random_spans(text, b, table, threshold))))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with its spans masked; spans that overlap or touch become one. A null text stays null."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def join(a: Column, x: Column) -> Column:
        own = F.struct(x["start"].alias("start"), x["end"].alias("end"))
        last = F.element_at(a, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(F.size(a) == 0, F.array(own)).when(x["start"] <= last["end"], F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(wider))).otherwise(F.concat(a, F.array(own)))

    def cut(m: Column) -> Column:
        before = F.transform(m, lambda x, i: F.substring(text, F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0) + 1, x["start"] - F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0)))
        rest = F.substring(text, F.element_at(m, -1)["end"] + 1, F.char_length(text))
        return F.concat(F.array_join(before, mask), F.lit(mask), rest)

    return F.when(F.size(spans) > 0, _let(F.aggregate(spans, empty, join), cut)).otherwise(text)


def trained_model(spark: SparkSession) -> list[float]:
    return train_markov(_samples(spark))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redacted_documents(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text masked, and n_chars, if docs has it, counted anew; rows and columns stay."""
    model = trained_model(docs.sparkSession)
    text = _let(F.struct(F.col("text").alias("t"), secret_spans(F.col("text"), model).alias("s")), lambda b: redact(b["t"], b["s"]))
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 8: spans of secrets in every document. Repeated rows and null ids are rows like others; no rows from none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), secret_spans(F.col("text"), trained_model(spark)).alias("spans"))
    count = [_of_kind(F.col("spans"), k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return found.select("doc_id", *count, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
