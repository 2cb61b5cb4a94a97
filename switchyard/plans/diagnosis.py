"""A diagnosis run over a user's own tables.

Every table is read once per check; all sections share one ``as_of`` instead
of independent ``NOW()`` calls; every finding counts towards the verdict.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import checks as K
from ..operators.setops import union_all


@dataclass(frozen=True)
class DiagnosisParams:
    """Look-backs and thresholds; defaults are the reference's values."""

    as_of: str
    agent_active_lookback: str = "5 minutes"
    call_rate_lookback: str = "30 minutes"
    log_lookback: str = "5 minutes"
    slot_stale: str = "10 minutes"
    slot_as_of: str | None = None
    midnight_as_of: str | None = None
    hopper_nearly_empty: int = 10
    hopper_low: int = 50
    amd_high_pct: float = 60
    amd_elevated_pct: float = 40
    drop_limit_pct: float = 5
    channel_ratio_limit: float = 3.0


def findings(t: Mapping[str, DataFrame], p: DiagnosisParams) -> DataFrame:
    """All findings whose inputs are present in ``t`` (view name -> frame).

    Each table is aggregated once for all of its numbers (SURVEY section
    3.1): one snapshot for the agents (plus the channel count), one for the
    hopper, one for the call log; per-campaign and per-line checks follow.
    Checks run whenever their own inputs are present: DNC entries in the
    hopper need only the hopper, as in the reference's query.
    """
    parts = []

    def has(*names):
        return all(n in t for n in names)

    if has("live_agents"):
        channels = t.get("channel_lines")
        snap = K.agents_channels_snapshot(t["live_agents"], channels, p.as_of, p.agent_active_lookback)
        specs = K.agent_specs(p.channel_ratio_limit, with_channels=channels is not None)
        parts.append(K.snapshot_findings(snap, list(specs.values())))
    if has("hopper", "campaigns"):
        parts.append(K.find_hopper_low(t["hopper"], t["campaigns"], p.hopper_nearly_empty, p.hopper_low))
    if has("hopper"):
        parts.append(K.snapshot_findings(K.hopper_snapshot(t["hopper"]), list(K.hopper_specs().values())))
    if has("call_log"):
        midnight = p.midnight_as_of or p.as_of
        snap = K.call_snapshot(t["call_log"], p.as_of, p.call_rate_lookback, midnight)
        specs = K.call_specs(p.amd_high_pct, p.amd_elevated_pct, p.drop_limit_pct, today=has("leads", "hopper"))
        parts.append(K.snapshot_findings(snap, list(specs.values())))
    if has("campaigns"):
        parts.append(K.find_amd_message(t["campaigns"]))
    if has("live_agents", "campaigns"):
        parts.append(K.find_zero_ready(t["live_agents"], t["campaigns"], p.as_of, p.agent_active_lookback))
    if has("process_rows"):
        parts.append(K.find_components(t["process_rows"]))
    if has("log_lines"):
        parts.append(K.find_log_errors(t["log_lines"], p.as_of, p.log_lookback))
    if has("conf_slots"):
        parts.append(K.find_slots(t["conf_slots"], p.slot_as_of or p.as_of, p.slot_stale))
    if has("leads", "hopper"):
        parts.append(K.lead_quality_findings(t["leads"], t["hopper"]))
    if has("registry_lines"):
        peers = t.get("peer_lines", t["registry_lines"].limit(0))
        parts.append(K.find_registration(t["registry_lines"], peers))
    if not parts:
        raise ValueError("no input tables for any check")
    return union_all(*parts)


def run(t: Mapping[str, DataFrame], p: DiagnosisParams) -> tuple[DataFrame, DataFrame]:
    """(findings, verdict) of one diagnosis run."""
    f = findings(t, p)
    return f, K.verdict(f)
