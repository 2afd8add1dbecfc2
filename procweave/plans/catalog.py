"""All registered queries; importing the plan modules fills the registry."""

from __future__ import annotations

from procweave.plans import base, extraction, flow_models, graph_queries, incremental, matching, outputs, resolution, search, segmentation, storage  # noqa: F401


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracles() -> dict[str, str]:
    return dict(base.ORACLES)
