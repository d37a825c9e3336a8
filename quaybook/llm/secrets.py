"""Secret scans by corpus-wide ownership frequency, with DataFrame functions only.

Candidates are what the fixed patterns find plus long mixed runs of letters and digits.  Hashes of candidate values are
aggregated over the whole corpus by distinct repositories and owners: a value that several owners hold, or that lies in many
repositories even of one owner, is a copied example; one that a single owner holds in few places and that looks random is live-looking.
Live-looking runs outside the fixed patterns' spans are added.

Positions are code points.  A pattern's matches are told apart from the text between them, and running sums of their lengths
give the positions, so texts with any number of matches are handled.

Defined cases: a null text is empty; a row without an owner is owned by its repository alone; repeated rows each get the same
result, and all owners of rows alike in id and text count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaybook.llm.shared import settle

#: Fixed patterns of the contract: kind, expression, group that holds the value, least length of that value.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # the runs of 24 and more are the same with the bound in the expression, and short ones cost nothing
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Runs that only ownership can judge.
RUN = ("live", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}+", 0, 20)
#: Equivalent quick tests of whether a text can hold a match at all.
MAY_HOLD = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "live": RUN[1],
}
#: Stands before the repository that is its own owner.
NO_OWNER = "without owner: "
#: Parts into which the spans of one value are split where they meet its verdict.
SALTS = 16
ORDER = {kind: k for k, (kind, *_) in enumerate((*BASE, RUN))}


def _found(body: Column, pattern: str, group: int) -> Column:
    """For each match: length of the text before it since the last match, its own length, its value."""
    before, whole = F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(body, F.lit(pattern), F.lit(group))
    return F.transform(
        F.arrays_zip(F.slice(before, 1, F.size(whole)).alias("b"), whole.alias("w"), values.alias("v")),
        lambda m: F.struct(F.length(m["b"]).alias("gap"), F.length(m["w"]).alias("len"), m["v"].alias("value")),
    )


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``doc_id, key, owner, repository, kind, start, end, value``, one row for each candidate span and owner of it.

    ``key`` tells rows with one id and different texts apart; rows alike in both and in their owner are one here.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    kinds = (*BASE, RUN)
    none = F.array().cast("array<struct<gap:int,len:int,value:string>>")
    found = [F.when(body.rlike(MAY_HOLD[kind]), _found(body, pattern, group)).otherwise(none).alias(kind) for kind, pattern, group, _ in kinds]
    ids = [
        F.col("doc_id"),
        F.xxhash64("text").alias("key"),
        F.coalesce(F.col(owner).cast("string"), F.concat(F.lit(NO_OWNER), F.col(repository).cast("string")), F.lit(NO_OWNER)).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
    ]
    rows = docs.select(*ids, *found).where(" or ".join(f"size({k}) > 0" for k, *_ in kinds)).dropDuplicates(["doc_id", "key", "owner", "repository"])
    each = F.explode(F.flatten(F.array(*[_tagged(kind, least) for kind, _, _, least in kinds])))
    spread = rows.select("doc_id", "key", "owner", "repository", each.alias("m"))
    so_far = Window.partitionBy("doc_id", "key", "owner", "repository", "m.kind").orderBy("m.k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(so_far)
    return (
        spread.withColumn("end", end)
        .where("m.passes")
        .select("doc_id", "key", "owner", "repository", F.col("m.kind").alias("kind"), (F.col("end") - F.col("m.len")).alias("start"), "end", F.col("m.value").alias("value"))
    )


def _tagged(kind: str, least: int) -> Column:
    return F.transform(
        F.col(kind),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("k"), m["gap"].alias("gap"), m["len"].alias("len"), m["value"].alias("value"), (F.length(m["value"]) >= least).alias("passes")
        ),
    )


def ownership(found: DataFrame, example_owners: int = 3, example_repositories: int = 10, least_symbols: int = 10) -> DataFrame:
    """``hash, n_repositories, n_owners, verdict`` for each candidate value of the corpus.

    The verdict is ``example`` from ``example_owners`` owners or ``example_repositories`` repositories on, ``live`` for one owner's value
    in fewer repositories and of at least ``least_symbols`` different characters, else ``unsure``.
    """
    symbols = F.size(F.array_distinct(F.split(F.col("value"), "")))
    hashed = found.select(F.sha2("value", 256).alias("hash"), symbols.alias("symbols"), "owner", "repository")
    # a hot value shrinks to its distinct holders before anything meets in one place; one repository may have several owners
    holders = hashed.groupBy("hash", "owner", "repository").agg(F.max("symbols").alias("symbols"))
    symbol = holders.groupBy("hash", "repository").agg(F.max("symbols").alias("symbols")).groupBy("hash").agg(F.count("*").alias("n_repositories"), F.max("symbols").alias("symbols"))
    owners = holders.groupBy("hash", "owner").count().groupBy("hash").agg(F.count("*").alias("n_owners"))
    totals = symbol.join(owners, "hash")
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories)
    verdict = F.when(copied, "example").when((F.col("n_owners") == 1) & (F.col("symbols") >= least_symbols), "live").otherwise("unsure")
    return totals.select("hash", "n_repositories", "n_owners", verdict.alias("verdict"))


def scan(
    docs: DataFrame, owner: str = "source", repository: str = "doc_id", example_owners: int = 3, example_repositories: int = 10, least_symbols: int = 10
) -> DataFrame:
    """One row for each document: counts of the fixed patterns, digest of their spans, all spans, and ownership counts."""
    found = settle(candidates(docs, owner, repository))
    values = ownership(found, example_owners, example_repositories, least_symbols)
    # one value may hold a third of all spans, so they meet its verdict in several places
    salted = values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spans = found.select("doc_id", "key", "kind", "start", "end", F.sha2("value", 256).alias("hash")).distinct()
    judged = spans.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key", "start"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    at = F.struct(F.col("start"), F.create_map(*[x for k, v in ORDER.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")].alias("o"), F.col("end"), F.col("kind"))
    grouped = judged.groupBy("doc_id", "key").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k, *_ in BASE],
        F.array_sort(F.collect_list(F.when(F.col("kind") != RUN[0], at))).alias("base"),
        F.array_sort(F.collect_list(F.when((F.col("kind") == RUN[0]) & (F.col("verdict") == "live"), at))).alias("live"),
        F.count_if((F.col("kind") != RUN[0]) & (F.col("verdict") == "live")).alias("n_live"),
        F.count_if((F.col("kind") != RUN[0]) & (F.col("verdict") == "example")).alias("n_example"),
    )
    apart = F.filter("live", lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    grouped = grouped.withColumn("added", apart).select(
        F.col("doc_id").alias("__id"),
        F.col("key").alias("__key"),
        *[f"n_{k}" for k, *_ in BASE],
        text(F.col("base")).alias("base_spans"),
        text(F.array_sort(F.concat("base", "added"))).alias("all_spans"),
        F.size("added").cast("long").alias("n_added"),
        "n_live",
        "n_example",
    )
    ids = docs.select("doc_id", F.xxhash64("text").alias("key"))
    out = ids.join(grouped, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        "doc_id",
        *[zero(f"n_{k}") for k, *_ in BASE],
        F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("all_spans", F.lit("")).alias("spans"),
        zero("n_added"),
        zero("n_live"),
        zero("n_example"),
    )
