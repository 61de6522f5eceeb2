"""Policies by context: layers of overrides joined so that the stricter value always wins."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import fixed as K

ALL = [c for c in K.CATEGORIES if c != "S0"]
OVERRIDE = (
    "struct<pii_enabled:boolean,pii_entities_add:array<string>,pii_action:string,pii_threshold:double,block_on_unsafe_input:boolean,"
    "block_on_unsafe_output:boolean,blocked_categories_add:array<string>,fail_open:boolean,timeout:int,cascade_mode:string,"
    "audit_logging:boolean,detailed_logging:boolean>"
)
#: Overrides by the values of a context; what is absent leaves a policy as it is.
PROFILES = {
    "deployment": {
        "development": dict(fail_open=True, cascade_mode="speed", pii_threshold=0.9, detailed_logging=True, audit_logging=False),
        "staging": dict(pii_enabled=True, block_on_unsafe_input=True, block_on_unsafe_output=True, cascade_mode="safety", audit_logging=True),
        "production": dict(pii_enabled=True, block_on_unsafe_input=True, block_on_unsafe_output=True, fail_open=False, cascade_mode="safety", audit_logging=True),
        "demo": dict(pii_enabled=True, block_on_unsafe_input=True, block_on_unsafe_output=True, pii_action="mask", cascade_mode="speed", detailed_logging=True),
        "compliance": dict(pii_enabled=True, pii_entities_add=K.PII_LABELS, pii_action="block", pii_threshold=0.3, block_on_unsafe_input=True, block_on_unsafe_output=True, blocked_categories_add=ALL, fail_open=False, cascade_mode="safety", audit_logging=True),
    },
    "region": {
        "eu": dict(pii_entities_add=["national_id", "tax_id", "iban", "eu_passport", "gdpr_special_category"], pii_action="block", pii_threshold=0.5, audit_logging=True),
        "uk": dict(pii_entities_add=["national_id", "nhs_number", "ni_number"], pii_action="block", pii_threshold=0.5, audit_logging=True),
        "ca": dict(pii_entities_add=["sin_number", "health_card"], pii_threshold=0.5, audit_logging=True),
        "us": {},
        "apac": dict(pii_entities_add=["aadhaar", "pan_card"]),
        "global": dict(pii_entities_add=["national_id", "tax_id", "iban", "eu_passport", "sin_number", "health_card", "nhs_number", "ni_number", "aadhaar", "pan_card"], pii_action="block", pii_threshold=0.3, audit_logging=True),
    },
    "industry": {
        "healthcare": dict(pii_entities_add=["medical_record_number", "insurance_id", "diagnosis_code", "prescription", "patient_id", "health_plan_id", "medical_device_id"], pii_action="block", pii_threshold=0.4, audit_logging=True),
        "finance": dict(pii_entities_add=["credit_card", "bank_account", "routing_number", "investment_account", "tax_id"], pii_action="block", pii_threshold=0.4, blocked_categories_add=["S6"], audit_logging=True),
        "education": dict(pii_entities_add=["student_id", "parent_name", "school_name", "grade_record", "disciplinary_record"], pii_threshold=0.5, blocked_categories_add=["S3", "S4", "S12"], audit_logging=True),
        "government": dict(pii_entities_add=["clearance_level", "government_id", "classified_marking"], pii_action="block", pii_threshold=0.3, blocked_categories_add=ALL, fail_open=False, cascade_mode="safety", audit_logging=True),
        "legal": dict(pii_entities_add=["case_number", "bar_number", "client_id"], pii_action="block", audit_logging=True),
        "general": {},
    },
    "auth_status": {
        "anonymous": dict(pii_threshold=0.5, blocked_categories_add=["S6"]),
        "authenticated": {},
        "service": dict(fail_open=False, cascade_mode="speed"),
    },
    "request_type": {
        "tool_call": dict(block_on_unsafe_input=True, pii_threshold=0.5, blocked_categories_add=["S14"]),
        "rag_retrieval": dict(pii_enabled=True),
        "rag_generation": dict(block_on_unsafe_output=True),
        "batch": dict(cascade_mode="speed", timeout=60),
        "embedding": dict(block_on_unsafe_input=False, block_on_unsafe_output=False, pii_enabled=True),
        "chat": {},
    },
}
LAYERS = list(PROFILES)


@dataclass(frozen=True)
class Policy:
    block_on_unsafe_input: bool = True
    block_on_unsafe_output: bool = True
    blocked_categories: tuple = tuple(K.BLOCKED)
    fail_open: bool = False
    timeout: int = 30
    pii_enabled: bool = True
    pii_entities: tuple = tuple(K.PII_LABELS)
    pii_action: str = "mask"
    pii_threshold: float = K.THRESHOLD
    cascade_mode: str = "safety"
    audit_logging: bool = False
    detailed_logging: bool = False
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 0 <= self.pii_threshold <= 1:
            raise ValueError("pii_threshold lies between 0 and 1")
        if self.pii_action not in ("mask", "block"):
            raise ValueError("pii_action is mask or block")

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]

    @classmethod
    def from_dict(cls, values: dict) -> tuple["Policy", list[str]]:
        """The policy of known keys, and the unknown keys; strings of booleans count as such."""
        known = {f.name: f for f in fields(cls)}
        truth = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}
        out = {}
        for k, v in values.items():
            if k in known:
                if isinstance(getattr(cls, k, None), bool) and isinstance(v, str):
                    v = truth[v.strip().lower()]
                out[k] = tuple(v) if isinstance(v, list) else v
        return cls(**out), [k for k in values if k not in known]


def _fold(base: Column, override: Column, name: str) -> Column:
    o = override[name if name not in ("pii_entities", "blocked_categories") else f"{name}_add"]
    if name in ("pii_entities", "blocked_categories"):
        return F.when(o.isNotNull(), F.array_union(base, o)).otherwise(base)
    if name in ("pii_threshold", "timeout"):
        return F.least(base, o)
    if name == "fail_open":
        return base & F.coalesce(o, F.lit(True))
    if name == "pii_action":
        rank = lambda c: F.when(c == "block", 2).when(c == "mask", 1).otherwise(0)
        return F.when(rank(o) > rank(base), o).otherwise(base)
    if name == "cascade_mode":
        return F.when((base == "safety") | (o == "safety"), "safety").when(o == "speed", "speed").otherwise(base)
    return base | F.coalesce(o, F.lit(False))


def profiles(spark: SparkSession, layer: str) -> DataFrame:
    rows = [(k, json.dumps(v)) for k, v in PROFILES[layer].items()]
    return spark.createDataFrame(rows, f"{layer} string, __o string").select(layer, F.from_json("__o", OVERRIDE).alias(f"__{layer}"))


def resolve(contexts: DataFrame, base: Policy = Policy()) -> DataFrame:
    """contexts (deployment, region, industry, auth_status, request_type) with struct policy.

    Equal contexts are resolved once.  Layers join in the order of LAYERS; unknown values change nothing.
    """
    distinct = contexts.select(*LAYERS).distinct()
    for layer in LAYERS:
        dim = F.broadcast(profiles(contexts.sparkSession, layer))  # a handful of rows, fixed above
        distinct = distinct.join(dim, layer, "left")
    names = [f.name for f in fields(Policy) if f.name != "extra"]
    cols = []
    for name in names:
        value = getattr(base, name)
        c = F.array(*[F.lit(x) for x in value]) if isinstance(value, tuple) else F.lit(value)
        for layer in LAYERS:
            c = _fold(c, F.col(f"__{layer}"), name)
        cols.append((F.array_sort(c) if isinstance(value, tuple) else c).alias(name))
    done = distinct.select(*[F.col(c).alias(f"__k_{c}") for c in LAYERS], F.struct(*cols).alias("policy"))
    cond = F.lit(True)
    for c in LAYERS:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    return contexts.join(done, cond).select(*contexts.columns, "policy")


def context_key(context: dict) -> str:
    """A digest of a context without its metadata."""
    return hashlib.sha256(json.dumps({k: v for k, v in context.items() if k != "metadata"}, sort_keys=True).encode()).hexdigest()[:16]


def is_empty(override: Column) -> Column:
    """Whether an override, a struct of OVERRIDE, leaves every policy as it is: all its fields are null."""
    names = [x.split(":")[0] for x in OVERRIDE.removeprefix("struct<").removesuffix(">").split(",") if ":" in x]
    return F.forall(F.array(*[override[x].isNull() for x in names]), lambda x: x)


def resolver_rates(contexts: DataFrame) -> DataFrame:
    """(cache_size, hits, misses, hit_rate in per cent with one decimal) of resolve(), one row: equal contexts hit."""
    n = contexts.groupBy(*LAYERS).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("misses"))
    hits = F.col("n") - F.col("misses")
    return n.select(F.col("misses").alias("cache_size"), hits.alias("hits"), "misses", F.round(hits / F.greatest("n", F.lit(1)) * 100, 1).alias("hit_rate"))


def effective(policy: Column) -> Column:
    """The policy of resolve() by what it governs: struct (pii (enabled, entities, action, threshold), content (enabled,
    blocked_categories, check_input, check_output))."""
    p = policy
    pii = F.struct(p["pii_enabled"].alias("enabled"), p["pii_entities"].alias("entities"), p["pii_action"].alias("action"), p["pii_threshold"].alias("threshold"))
    either = p["block_on_unsafe_input"] | p["block_on_unsafe_output"]
    content = F.struct(either.alias("enabled"), p["blocked_categories"].alias("blocked_categories"), p["block_on_unsafe_input"].alias("check_input"), p["block_on_unsafe_output"].alias("check_output"))
    return F.struct(pii.alias("pii"), content.alias("content"))
