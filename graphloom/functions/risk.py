"""Scores and labels of an impact analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blast_score(direct, transitive) -> Column:
    return F.round(F.col(direct) + 0.5 * F.col(transitive), 2)


def risk_label(score: Column, total: Column) -> Column:
    pct = score / total * 100
    bands = [("CRITICAL", 20, 30), ("HIGH", 10, 15), ("MEDIUM", 4, 5)]
    out = F.when(total == 0, "UNKNOWN")
    for label, least, share in bands:
        out = out.when((score >= least) | (pct >= share), label)
    return out.otherwise("LOW")


def affected_pct(direct, transitive, total: Column) -> Column:
    return F.when(total > 0, F.round((F.col(direct) + F.col(transitive)) * 100 / total, 1))


#: Which node types and languages belong to which layer.
INFRA_TYPES = ["service", "pipeline", "database"]
FRONT_LANGUAGES = ["javascript", "typescript", "vue", "css", "scss", "less", "sass"]
INFRA_LANGUAGES = ["docker", "github-actions", "gitlab-ci", "sql", "prisma", "terraform"]
RENDERING = ["component", "route"]


def layer(node_type: Column, language: Column) -> Column:
    infra = F.coalesce(node_type.isin(*INFRA_TYPES), F.lit(False)) | (F.coalesce(language.isin(*INFRA_LANGUAGES), F.lit(False)))
    front = ~F.coalesce(node_type.isin(*INFRA_TYPES), F.lit(False)) & language.isin(*FRONT_LANGUAGES)
    return F.when(front, "frontend").when(infra, "infrastructure").otherwise("backend")


def link_kind(source_type: Column, target_type: Column) -> Column:
    """styles > depends > renders > imports: the first that fits; a missing type is a module."""
    ends = [F.coalesce(t, F.lit("module")) for t in (source_type, target_type)]
    either = lambda kinds: ends[0].isin(*kinds) | ends[1].isin(*kinds)
    both = ends[0].isin(*RENDERING) & ends[1].isin(*RENDERING)
    return F.when(either(["style"]), "styles").when(either(INFRA_TYPES), "depends").when(both, "renders").otherwise("imports")
