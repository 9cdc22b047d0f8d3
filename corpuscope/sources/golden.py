"""Readers of golden sets: retrieval cases (one JSON object per line) and agent attempts (one JSON document)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETRIEVAL_SCHEMA = "id string, query string, relevantDocumentIds array<string>, topK int, note string"
ATTEMPT_SCHEMA = (
    "caseId string, attemptIndex int, expectedClarification boolean, actualClarification boolean, "
    "expectedClarificationSlots array<string>, actualClarificationSlots array<string>, expectedTrajectory array<string>, "
    "actualTrajectory array<string>, expectedTools array<struct<name:string,argumentsFingerprint:string>>, "
    "actualTools array<struct<name:string,argumentsFingerprint:string>>, expectedCitationIds array<string>, "
    "actualCitationIds array<string>, requiredClaimIds array<string>, supportedClaimIds array<string>, "
    "duplicateActionCount int, totalActionCount int, expectedTerminalReason string, actualTerminalReason string, passed boolean, "
    "signals struct<expectedIntent:string,actualIntent:string,expectedEvidenceStatus:string,actualEvidenceStatus:string,"
    "expectedConflict:boolean,actualConflict:boolean,recoveryAttempt:boolean,recoverySucceeded:boolean,reusedStepCount:int,"
    "duplicateSideEffectCount:int,writeActionCount:int,latencyMs:bigint,promptTokens:int,completionTokens:int>"
)


def read_retrieval_golden(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, qrels): queries with their k, and one row per relevant document id."""
    raw = spark.read.schema(RETRIEVAL_SCHEMA).json(path)
    cases = raw.select(F.col("id").alias("case_id"), F.col("query").alias("text"), F.coalesce("topK", F.lit(8)).alias("k"))
    qrels = raw.select(F.col("id").alias("case_id"), F.explode(F.array_distinct("relevantDocumentIds")).alias("document_id"))
    return cases, qrels


def read_agent_golden(spark: SparkSession, path: str, *, one_document_per_file: bool = True) -> DataFrame:
    """One row per attempt of ``{"attempts": [...]}`` documents: one document per file, or one per line."""
    raw = spark.read.schema(f"attempts array<struct<{_nested(ATTEMPT_SCHEMA)}>>").option("multiLine", one_document_per_file).json(path)
    return raw.select(F.explode("attempts").alias("a")).select("a.*")


def _nested(ddl: str) -> str:
    """'name type' fields at the top level as 'name:type'."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = ddl[start:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(out)
