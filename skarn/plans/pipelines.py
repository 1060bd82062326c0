"""Named stages composed into one plan (Q01-Q03): all queries run at once, and earlier outputs are at hand by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as R

Stage = Callable[[Mapping[str, DataFrame], Mapping], DataFrame]


def _bm25(at: Mapping[str, DataFrame], opts: Mapping) -> DataFrame:
    return R.bm25_top_k(at["docs"], at["queries"], opts.get("k", 50))


def _dense(at: Mapping[str, DataFrame], opts: Mapping) -> DataFrame:
    return R.knn_cosine(at["vectors"], at["query_vectors"], opts.get("k", 50))


def _rrf(at: Mapping[str, DataFrame], opts: Mapping) -> DataFrame:
    weights = opts.get("weights", {})
    return R.rrf([(at[name], weights.get(name, 1.0)) for name in opts["inputs"]], opts.get("rrf_k", 60), opts.get("k"))


def _filter(at: Mapping[str, DataFrame], opts: Mapping) -> DataFrame:
    return R.filter_by_score(at[opts["input"]], opts["least"], opts.get("k", 10))


def _rerank(at: Mapping[str, DataFrame], opts: Mapping) -> DataFrame:
    hits = at[opts["input"]].join(at["docs"], "docid")
    return R.soft_rerank(hits, [(F.contains("text", F.lit(w)), v) for w, v in opts["terms"].items()]).select("qid", "docid", "score", "rank")


STAGES: dict[str, Stage] = {"bm25": _bm25, "dense": _dense, "rrf": _rrf, "filter": _filter, "rerank": _rerank}


def run(spec: Sequence[Mapping], tables: Mapping[str, DataFrame], extra: Mapping[str, Stage] | None = None) -> dict[str, DataFrame]:
    """Outputs by stage name. spec: mappings with name, type and the type's options; an unknown type is an error."""
    kinds = STAGES | dict(extra or {})
    at = dict(tables)
    for step in spec:
        if step["type"] not in kinds:
            raise ValueError(f"unknown stage type {step['type']!r}; known are {', '.join(sorted(kinds))}")
        at[step["name"]] = kinds[step["type"]](at, step)
    return at
