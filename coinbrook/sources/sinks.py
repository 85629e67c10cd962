"""Files that leave the workspace: error reports, knowledge, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinbrook.functions import text
from coinbrook.operators import duplicates, knowledge

REPORT_COLUMNS = ("source_location", "code", "severity", "field", "message", "rejected", "correction")


def error_report(issues: DataFrame) -> DataFrame:
    """value: a CSV line for each issue, every cell quoted and safe; columns that ``issues`` lacks are empty."""
    have = set(issues.columns)
    cells = [text.report_cell(F.col(c) if c in have else F.lit("")) for c in REPORT_COLUMNS]
    return issues.select(F.concat_ws(",", *cells).alias("value"))


def write_error_report(issues: DataFrame, path: str) -> None:
    """``error_report`` as files, CRLF between the lines."""
    error_report(issues).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def fingerprints(ledger: DataFrame) -> DataFrame:
    """The fingerprint table, made anew from all rows."""
    composed = F.lower(text.nfkc(F.col("description")))
    return ledger.select("txn_id", "account_id", duplicates.fingerprint(composed).alias("fingerprint"), F.lit(1).alias("version"))


def write_knowledge(sections: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each section, in order of id, keys in alphabetical order; of recurring decisions only settled ones."""
    for name, df in sections.items():
        if name == "recurring_decisions":
            df = df.filter("status in ('confirmed', 'dismissed', 'muted')")
        df.orderBy("id").select(knowledge.canonical_json(*df.columns).alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def read_knowledge(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The sections written by ``write_knowledge``; a line that does not fit its schema raises."""
    return {name: spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{name}") for name, schema in schemas.items()}


def write_backup(sections: dict[str, DataFrame], path: str) -> None:
    """Parquet for each section, and the manifest last: a backup without one is not complete."""
    for name, df in sections.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    knowledge.manifest({n: sections[n].sparkSession.read.parquet(f"{path}/{n}") for n in sections}).write.mode("overwrite").parquet(f"{path}/manifest")


def read_backup(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sections of a backup; raises if counts or digests differ from the manifest."""
    expected = spark.read.parquet(f"{path}/manifest")
    names = [r.section for r in expected.select("section").collect()]  # one row a section
    sections = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    wrong = [r.section for r in knowledge.verify_manifest(expected, sections).collect()]
    if wrong:
        raise ValueError(f"sections differ from the manifest: {wrong}")
    return sections
