"""From a plan and files to a proven index: ingest, index, group, check, sweep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import access, audit, ingest, profiles
from ..operators.index import Index, build_index


class BuildError(Exception):
    """A step failed; the message names it."""


@dataclass
class Build:
    chunks: DataFrame
    manifest: DataFrame
    index: Index
    audience: DataFrame
    adapters: DataFrame
    summary: DataFrame
    passed: bool


def build(files: DataFrame, policy: access.Policy, families: DataFrame, samples: int = 3) -> Build:
    """Stops at the first step that fails; passes if the sweep found nothing and was able to."""
    step = "policy"
    try:
        policy.require()
        step = "ingest"
        chunks, manifest = ingest.ingest(files)
        chunks = ingest.require_labels(chunks)
        if chunks.isEmpty():
            raise ValueError("no file gave a chunk")
        step = "index"
        # Ranks by source and place: dense, and the same in every run.
        index = build_index(ingest.with_ranks(chunks, "source", "start_char").withColumnRenamed("_rank", "row"))
        step = "grouping"
        cents, _ = profiles.centroids(index.chunks, "compartment")
        if problems := profiles.declared(families, cents, allow_unlisted=True).where("problem = 'in two families'").collect():
            raise ValueError("; ".join(f"{r['compartment']} is {r['problem']}" for r in problems))
        audience, adapters = access.audience_check(policy, families), access.adapters_per_person(policy, families)
        step = "sweep"
        summary = audit.sweep_summary(*audit.sweep(index, policy, samples), policy)
        passed = summary.where(~F.col("passed")).isEmpty()
    except Exception as e:
        raise BuildError(f"step {step}: {e}") from e
    return Build(chunks, manifest, index, audience, adapters, summary, passed)
