"""Secret scans over an incremental blob ledger, by DataFrame operations alone.

Every version of every file is content-addressed (SHA-256 of its text). The ledger is
an append-only Parquet table in the shared folder with one row per scan of a blob:
``blob``, ``scanned`` (keys of the rule versions applied) and ``findings``. A run reads
the ledger first, scans only blobs, and on them only rule versions, that it lacks,
appends what it scanned and joins the findings back to every version that has the
blob. A run that dies before its append leaves nothing; repeating it scans again.

Positions come from the two built-in functions that agree on where a pattern
matches: ``split`` gives what lies between the matches, ``regexp_extract_all`` the
matches; a running sum of lengths places them.

Null text counts as empty, equal texts are one blob, repeated versions all get their
blob's findings. ``findings_of`` keeps every column, and where the versions have a
column of its names (``blob``, ``findings``), its own get an underscore more; the scan
ignores extra columns. Empty tables give empty results and append nothing. Overlapping
findings of different rules all count; ties in position go by the order of the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.shared import free_name

LEDGER_SCHEMA = "blob string, scanned array<string>, findings array<struct<start:int,rule:int,end:int,kind:string>>"
NO_FINDINGS = "array<struct<start:int,rule:int,end:int,kind:string>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; kept if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules in the order that breaks ties, then the added one.
#: A run of [0-9a-f] of 24 or more is what is left of all runs after dropping short ones,
#: and likewise for the access rule; the assign rule has to match first and drop then.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (*BASE_RULES, Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"))


def address(text: str = "text") -> Column:
    """The content address of a text."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the ledger, none where nobody has written one yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_ledger(spark)


def _matches(rule: Rule, text: Column, due: Column) -> Column:
    """Per match: length of what stands before it, its own and its group's; last what remains."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )
    sizes = F.transform(found, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("whole"), F.length(x["part"]).alias("part")))
    return F.when(due & text.rlike(rule.pattern), sizes)


def _tagged(k: int, rule: Rule, due: Column) -> Column:
    none = F.array().cast("array<struct<gap:int,whole:int,part:int>>")
    tags = [F.lit(k).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rule.least).alias("least")]
    sizes = F.coalesce(_matches(rule, F.col("_text"), due), none)
    return F.transform(sizes, lambda x: F.struct(*tags, x["gap"].alias("gap"), x["whole"].alias("whole"), x["part"].alias("part")))


def spans_of_kind(findings: Column, *kinds: str) -> Column:
    return F.filter(findings, lambda x: x["kind"].isin(*kinds))


def scan_unseen(versions: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """New ledger rows: blobs, or rules on blobs, that ``ledger`` has not seen.

    Equal blobs collapse before the shuffle (partial aggregation), so copies of one
    text cost one row per task however many there are.
    """
    blobs = versions.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("blob", address("_text")).dropDuplicates(["blob"])
    if ledger is None:
        blobs = blobs.withColumn("_seen", F.array().cast("array<string>"))
    else:
        seen = ledger.select("blob", F.explode("scanned").alias("key")).groupBy("blob").agg(F.collect_set("key").alias("_seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("_seen", F.coalesce("_seen", F.array().cast("array<string>")))
    blobs = blobs.withColumn("scanned", F.array_except(F.array(*(F.lit(r.key) for r in rules)), "_seen")).where(F.size("scanned") > 0)
    per_rule = [_tagged(k, r, F.array_contains("scanned", r.key)) for k, r in enumerate(rules)]
    scanned = blobs.select("blob", "scanned", F.posexplode_outer(F.concat(*per_rule)).alias("at", "x")).select("blob", "scanned", "at", "x.*")
    so_far = Window.partitionBy("blob", "rule").orderBy("at")
    end = F.sum(F.col("gap") + F.coalesce("whole", F.lit(0))).over(so_far).cast("int")
    placed = scanned.withColumn("end", end).withColumn("start", F.col("end") - F.col("whole"))
    good = F.when(F.col("part") >= F.col("least"), F.struct("start", "rule", "end", "kind"))
    return placed.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.array_sort(F.collect_list(good)).alias("findings"))


def scan(versions: DataFrame, rules: tuple[Rule, ...], path: str, text: str = "text") -> DataFrame:
    """Bring the ledger at ``path`` up to date with these versions and rules; returns all of it.

    ``path`` lies in a folder that all executors share. Runs on one ledger go one after another.
    """
    spark = versions.sparkSession
    ledger = read_ledger(spark, path)
    scan_unseen(versions, rules, ledger, text).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings_of(versions: DataFrame, ledger: DataFrame, text: str = "text", blob: str | None = None, findings: str | None = None) -> DataFrame:
    """All versions with their blob and its findings, from whatever scans of it are in the ledger.

    The two columns are named ``blob`` and ``findings``, or as given, or with underscores
    behind where the versions have such columns.
    """
    blob, findings = blob or free_name(versions, "blob"), findings or free_name(versions, "findings")
    found = ledger.where(F.size("findings") > 0).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias(findings)).withColumnRenamed("blob", blob)
    return versions.withColumn(blob, address(text)).join(found, blob, "left").withColumn(findings, F.coalesce(findings, F.array().cast(NO_FINDINGS)))


def digest(findings: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(text: Column, findings: Column, mask: str = "[SECRET]") -> Column:
    """The text with every found span, overlapping ones as one, replaced by a mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        add = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], add).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(findings, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(findings) > 0, whole).otherwise(text)
