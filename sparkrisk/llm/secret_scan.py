"""Secret scans: multipart credential linking by an interval join.

A credential has an identifier, a secret and sometimes an endpoint. Base kinds are reported
wherever they stand: ``assign`` and ``hex`` (secrets), ``access`` (identifiers). Weak kinds
look like a part of a credential but are common in harmless text; they are reported only
when the other parts stand close by in the same scope, the document:

* ``login`` (user name or client id assignment): a secret within ``reach`` code points,
* ``bare`` (a lone 40-character token): an identifier within reach,
* ``endpoint`` (a URL): an identifier and a secret within reach.

A weak span that overlaps a base span is the base span's and is not reported again.

The interval join is an equality join on (row, bucket of code points): a part is in every
bucket it covers, a weak span in every bucket its widened interval covers. Spans of a kind
do not overlap, so a bucket holds a bounded number of them and the join stays in proportion
to the spans. Positions come from the lengths of the text between matches, summed by a
window. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkrisk.llm.common import text_of
from sparkrisk.workspace import written

REACH = 200
BUCKET = 256

#: kind: (pattern, group that counts, its least length, text the document must hold)
PATTERNS = {
    "assign": ("(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?"
               "([A-Za-z0-9+/_.=-]+)", 2, 6, ["=", ":"]),
    "access": ("AKIA[A-Z0-9]+", 0, 20, ["AKIA"]),
    "hex": ("[0-9a-f]{24,}", 0, 24, []),
    "login": ("(?i:\\b(user|user_?name|login|client_?id|account_?id))[\"']?\\x20*[:=]\\x20*"
              "[\"']?([A-Za-z0-9+_.@-]+)", 2, 3, ["=", ":"]),
    "bare": ("(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40, []),
    "endpoint": ("https?://[^\\x00-\\x20\"'<>]+", 0, 10, ["://"]),
}
KINDS = list(PATTERNS)
BASE = KINDS[:3]
IDENTIFIERS = ["access", "login"]
SECRETS = ["assign", "hex", "bare"]


def _matches(kind: str) -> Column:
    """(kind, length of the text before the match, of the match, of the group) in order."""
    pattern, group, _, needs = PATTERNS[kind]
    text, rule = F.col("_text"), F.lit(pattern)
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, rule, F.lit(0)), lambda x: F.length(x)).alias("own"),
        F.transform(F.regexp_extract_all(text, rule, F.lit(group)),
                    lambda x: F.length(x)).alias("part"))
    rows = F.transform(parts, lambda x, i: F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), i.alias("nth"), x["gap"].alias("gap"),
        x["own"].alias("own"), x["part"].alias("part")))
    some = F.lit(False) if needs else text.rlike(pattern)
    for need in needs:
        some = some | text.contains(need)
    return F.when(some, F.filter(rows, lambda x: x["own"].isNotNull())).otherwise(
        F.array().cast("array<struct<kind:int,nth:int,gap:int,own:int,part:int>>"))


def spans_of(narrow: DataFrame) -> DataFrame:
    """Rows (rid, kind, start, end): matches whose counting group is long enough."""
    hits = narrow.select("rid", F.explode("hits").alias("hit")).select("rid", "hit.*")
    upto = (Window.partitionBy("rid", "kind").orderBy("nth")
            .rowsBetween(Window.unboundedPreceding, 0))
    least = F.array(*[F.lit(PATTERNS[k][2]) for k in KINDS])
    end = F.sum(F.col("gap") + F.col("own")).over(upto)
    return (hits.withColumn("end", end).where(F.col("part") >= F.get(least, F.col("kind")))
            .select("rid", "kind", (F.col("end") - F.col("own")).alias("start"), "end"))


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak spans that have their complementary parts within reach."""
    def kinds(names: list[str]) -> Column:
        return F.col("p_kind").isin([KINDS.index(k) for k in names])

    bucket = lambda x: F.floor(x / BUCKET)
    weak = spans.where(F.col("kind") >= len(BASE)).withColumn("bucket", F.explode(F.sequence(
        bucket(F.col("start") - reach), bucket(F.col("end") + reach))))
    parts = spans.select("rid", F.col("kind").alias("p_kind"), F.col("start").alias("p_start"),
                         F.col("end").alias("p_end"), F.explode(F.sequence(
                             bucket(F.col("start")), bucket(F.col("end")))).alias("bucket"))
    near = ((F.col("p_start") < F.col("end") + reach) & (F.col("p_end") > F.col("start") - reach)
            & (F.col("p_kind") != F.col("kind")))
    same = ((F.col("p_start") < F.col("end")) & (F.col("p_end") > F.col("start"))
            & (F.col("p_kind") < len(BASE)))
    met = weak.join(parts, ["rid", "bucket"]).where(near).groupBy(
        "rid", "kind", "start", "end").agg(
        F.max(same).alias("taken"), F.max(kinds(IDENTIFIERS)).alias("identified"),
        F.max(kinds(SECRETS)).alias("secret"))
    is_kind = lambda name: F.col("kind") == KINDS.index(name)
    return met.where(~F.col("taken") & (
        (is_kind("login") & F.col("secret")) | (is_kind("bare") & F.col("identified"))
        | (is_kind("endpoint") & F.col("identified") & F.col("secret")))
        ).select("rid", "kind", "start", "end")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                reach: int = REACH) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Positions are code points, ends exclusive. Base kinds are leftmost and non-overlapping
    per kind; spans lists base and linked weak spans by start, then kind. Null counts as
    empty text. Repeated rows and ids are scanned each on their own; an empty table gives no
    rows. A pattern that does not stop at a line end does not need to: none spans one.
    """
    narrow = written(
        docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text"))
        .select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                F.concat(*[_matches(k) for k in KINDS]).alias("hits")), "secret-hits")
    spans = written(spans_of(narrow.where(F.size("hits") > 0)), "secret-spans")
    strong = spans.where(F.col("kind") < len(BASE))
    every = strong.unionByName(linked(spans, reach)).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    names = F.array(*[F.lit(k) for k in KINDS])
    every_span = F.coalesce("all", F.array().cast(
        "array<struct<start:bigint,kind:int,end:bigint>>"))
    base = F.filter(every_span, lambda x: x["kind"] < len(BASE))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda n: F.size(F.filter(every_span, lambda x: x["kind"] == n)).cast("long")
    return narrow.select("rid", "doc_id").join(every, "rid", "left").select(
        "doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(BASE)],
        F.sha2(said(base), 256).alias("base_sha256"), said(every_span).alias("spans"),
        (F.size(every_span) - F.size(base)).cast("long").alias("n_linked"))


def op10_secret_scan(spark, sf_dir):
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
