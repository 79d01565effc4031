"""Declared schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATES = "array<struct<vulnSlug:string,lineNumbers:array<int>,snippet:string,matchedPattern:string>>"
TRIAGE = "struct<priority:string,exploitability:string,impact:string,reasoning:string,triagedAt:string,model:string>"
VERDICT = "struct<verdict:string,reasoning:string,adjustedSeverity:string,revalidatedAt:string,runId:string,model:string>"
FINDING = f"struct<severity:string,vulnSlug:string,title:string,description:string,lineNumbers:array<int>,recommendation:string,confidence:string,triage:{TRIAGE},revalidation:{VERDICT},producedByRunId:string,agreeingAgents:array<string>>"
USAGE = "struct<inputTokens:bigint,outputTokens:bigint,cacheReadInputTokens:bigint,cacheCreationInputTokens:bigint>"
REFUSAL = "struct<refused:boolean,reason:string,skipped:array<struct<filePath:string,reason:string>>,raw:string>"
HISTORY = f"struct<runId:string,investigatedAt:string,durationMs:bigint,durationApiMs:bigint,agentType:string,model:string,modelConfig:string,agentSessionId:string,findingCount:int,numTurns:int,phase:string,costUsd:double,usage:{USAGE},refusal:{REFUSAL},codexStderr:string,reinvestigateMarker:int>"
PERSON = "struct<name:string,email:string,date:string>"
OWNERSHIP = (
    "struct<contributors:array<struct<email:string,name:string,github_username:string,score:double,context:string,last_contrib:string>>,"
    "escalationTeams:array<struct<name:string,slug:string,source:string,escalation_path_id:string,slack_channel_id:string,manager:struct<email:string,slack_user_id:string>,current_oncall:struct<name:string,email:string,slack_user_id:string,github_username:string>>>,"
    "approvers:array<struct<owner:string,owner_type:string,pattern:string,is_primary:boolean,is_direct:boolean>>,fetchedAt:string>"
)
RECORD = (
    f"filePath string, projectId string, candidates {CANDIDATES}, lastScannedAt string, lastScannedRunId string, fileHash string, lastMatcherPackHash string, "
    f"findings array<{FINDING}>, analysisHistory array<{HISTORY}>, gitInfo struct<recentCommitters:array<{PERSON}>,enrichedAt:string,ownership:{OWNERSHIP}>, status string, lockedByRunId string, lockedAt string"
)
RUN = (
    "runId string, projectId string, rootPath string, createdAt string, completedAt string, type string, phase string, "
    "scannerConfig struct<matcherSlugs:array<string>,mode:string,source:string,fileCount:int>, "
    "processorConfig struct<agentType:string,model:string,modelConfig:string,invocationMode:string,source:string>, "
    "stats struct<filesScanned:int,candidatesFound:int,filesProcessed:int,findingsCount:int,totalCostUsd:double,totalInputTokens:bigint,totalOutputTokens:bigint,totalDurationMs:bigint,findingsRevalidated:int,truePositives:int,falsePositives:int,fixed:int,uncertain:int>"
)

# fixed values: the order of severities; unknown ones rank 0
SEVERITY = {"CRITICAL": 6, "HIGH": 5, "HIGH_BUG": 4, "MEDIUM": 3, "BUG": 2, "LOW": 1}


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY.items():
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def findings_of(records: DataFrame) -> DataFrame:
    """(project, path, idx, the finding's fields): one row a finding, with its place in the record."""
    rows = records.select(F.col("projectId").alias("project"), F.col("filePath").alias("path"), F.posexplode("findings").alias("idx", "f"))
    return rows.select("project", "path", "idx", "f.*")


def candidates_of(records: DataFrame) -> DataFrame:
    rows = records.select(F.col("projectId").alias("project"), F.col("filePath").alias("path"), F.posexplode("candidates").alias("idx", "c"))
    return rows.select("project", "path", "idx", F.col("c.vulnSlug").alias("slug"), F.get("c.lineNumbers", F.lit(0)).alias("line"), F.col("c.matchedPattern").alias("label"), F.col("c.snippet").alias("snippet"))


def history_of(records: DataFrame) -> DataFrame:
    rows = records.select(F.col("projectId").alias("project"), F.col("filePath").alias("path"), F.posexplode("analysisHistory").alias("pos", "h"))
    return rows.select("project", "path", "pos", "h.*")
