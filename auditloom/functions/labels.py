"""Finding dimensions: confidence, references, effort, advice.

All constants here are fixed values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MISSING_FEATURE_WORDS = ("Missing Pause", "Missing Event", "Hardcoded Address")


def evidence_confidence(severity: Column, line: Column, name: Column, vuln_type: Column) -> Column:
    """Base by severity, more for a line and a name, less for recommendations; 0..99."""
    base = F.when(severity == 5, 80).when(severity == 4, 70).when(severity == 3, 60).when(severity == 2, 50).otherwise(40)
    raised = base + F.when(line > 0, 8).otherwise(0) + F.when(F.coalesce(name, F.lit("")) != "", 5).otherwise(0)
    feature = F.lit(False)
    for w in MISSING_FEATURE_WORDS:
        feature = feature | F.contains(vuln_type, F.lit(w))
    lowered = raised - F.when(feature, 30).otherwise(0)
    return F.least(F.lit(99), F.greatest(F.lit(0), lowered))


#: engine -> severity -> confidence; engines with one constant use key 0.
ENGINE_CONFIDENCE: dict[str, dict[int, int]] = {
    "SEC3": {5: 88, 4: 82, 3: 75, 2: 65, 1: 50},
    "GEI": {5: 92, 4: 88, 3: 82, 2: 75},
    "ANCHOR": {5: 90, 4: 85, 3: 78, 2: 70},
    "KANI": {0: 94},
    "CERTORA": {0: 90},
    "TRIDENT": {0: 82},
    "FDS": {0: 92},
}


def engine_confidence(engine: Column, severity: Column, score: Column, triggered: Column) -> Column:
    """Confidence an engine's rows enter the common table with."""
    out = F.when(engine == "L3X", F.floor(score * 100).cast("int")).when(
        engine == "WACANA", F.when(triggered, 98).otherwise(88))
    for name, by in ENGINE_CONFIDENCE.items():
        if 0 in by:
            out = out.when(engine == name, by[0])
        else:
            for sev, c in by.items():
                out = out.when((engine == name) & (severity == sev), c)
    return out


#: taxonomy -> (reference id, incident, effort units)
HISTORY: dict[str, tuple[str, str, int]] = {
    "MissingSignerCheck": ("CVE-2022-2909", "Wormhole", 5000),
    "OracleManipulation": ("MANGO-2022", "Mango Markets", 85000),
    "Reentrancy": ("CVE-SOL-REENT", "Cream Finance", 45000),
    "MissingOwnerCheck": ("CVE-SOL-OWNER", "Cashio", 5000),
    "IntegerOverflow": ("CVE-SOL-OVERFLOW", "Silent wrap in release builds", 15000),
    "ArbitraryCPI": ("CREMA-2022", "Crema Finance", 35000),
}
DEFAULT_EFFORT = 10000

#: category -> CWE of the unsafe-code and AST rule engines.
CATEGORY_CWE: dict[str, str] = {
    "UnsafeBlock": "CWE-119",
    "UnsafeFunction": "CWE-676",
    "UnsafeTrait": "CWE-1021",
    "FFICall": "CWE-111",
    "RawPointer": "CWE-822",
    "TransmuteCall": "CWE-704",
    "InlineAssembly": "CWE-1242",
    "UnionType": "CWE-843",
    "UnsafeDeref": "CWE-476",
    "UnsafeCast": "CWE-704",
    "MissingOwnerCheck": "CWE-284",
    "IntegerOverflow": "CWE-190",
    "AccountConfusion": "CWE-345",
    "MissingSignerCheck": "CWE-287",
    "DuplicateMutableAccounts": "CWE-362",
    "ArbitraryCPI": "CWE-94",
    "MissingRentExemption": "CWE-670",
    "InsecurePDADerivation": "CWE-330",
    "CloseAccountDrain": "CWE-672",
    "MissingDiscriminator": "CWE-345",
    "ReInitialization": "CWE-665",
    "UncheckedRemainingAccounts": "CWE-20",
}


def lookup(key: Column, table: dict, default=None) -> Column:
    """Constant lookup as one literal map; the table is code, so its size is fixed."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def history(tax: Column) -> dict[str, Column]:
    return {
        "reference_id": lookup(tax, {k: v[0] for k, v in HISTORY.items()}),
        "incident": lookup(tax, {k: v[1] for k, v in HISTORY.items()}),
        "effort_units": lookup(tax, {k: v[2] for k, v in HISTORY.items()}, DEFAULT_EFFORT),
    }
