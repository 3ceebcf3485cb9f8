"""Variant profiles: globs over vendor, model and firmware, and their registry."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytesx import glob_regex

#: Weights of family, vendor, model and firmware: fixed values.
WEIGHTS = {"family": 0.05, "vendor": 0.35, "model": 0.40, "firmware": 0.20}
SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Profile:
    profile_id: str
    family_id: str
    vendor: tuple[str, ...] = ()
    model: tuple[str, ...] = ()
    firmware: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)


def load(pack: dict) -> list[Profile]:
    """Profiles of a JSON pack; an unknown version, a missing id or one given twice is an error."""
    if pack.get("schema_version") != SCHEMA_VERSION or not isinstance(pack.get("profiles"), list):
        raise ValueError("not a profile pack of this version")
    out = []
    for p in pack["profiles"]:
        if not p.get("profile_id") or not p.get("family_id"):
            raise ValueError("a profile needs profile_id and family_id")
        out.append(Profile(p["profile_id"], p["family_id"], *(tuple(p.get(f"{k}_patterns", ())) for k in ("vendor", "model", "firmware")), p.get("parameters", {})))
    if len({p.profile_id for p in out}) != len(out):
        raise ValueError("profile ids must be unique")
    return out


def match(devices: DataFrame, profiles: list[Profile]) -> DataFrame:
    """device, profile_id and score of each match, by device, then score falling, then profile_id. devices: device, vendor, model, firmware.

    No pattern matches anything for its weight; patterns and no value, or none that matches, rule a profile out.
    The profiles are parameters, so the join is an explode of a literal array.
    """

    def part(name: str, patterns: tuple[str, ...]) -> F.Column:
        if not patterns:
            return F.lit(WEIGHTS[name])
        met = F.lower(F.col(name)).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))
        return F.when(met, WEIGHTS[name])

    scored = [F.struct(F.lit(p.profile_id).alias("profile_id"), (F.lit(WEIGHTS["family"]) + part("vendor", p.vendor) + part("model", p.model) + part("firmware", p.firmware)).alias("score")) for p in profiles]
    return devices.withColumn("m", F.explode(F.array(*scored))).where("m.score is not null").select("device", "m.profile_id", F.round("m.score", 6).alias("score")).orderBy("device", F.desc("score"), "profile_id")
