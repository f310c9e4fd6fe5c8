"""Small literal tables that stand in for what the test tables don't hold: a policy, families
of compartments, runs, weight tables. Their sizes don't depend on any corpus."""

from __future__ import annotations

COMPARTMENTS = [f"src{j}" for j in range(20)]
#: One company-wide source, some departments, the rest restricted; two rules are broken.
TIERS = {c: "company" if j == 0 else "department" if j < 10 else "restricted" for j, c in enumerate(COMPARTMENTS)}
VOLATILE = {"src9", "src18"}
GRANTS = {
    "p0": COMPARTMENTS,
    "p1": [f"src{j}" for j in range(0, 20, 2)],
    "p2": [f"src{j}" for j in range(5)],
    "p3": ["src0", "src3", "src19"],
    "p4": ["src0"],
}
POLICY = {
    "compartments": [{"name": c, "tier": TIERS[c], "volatile": c in VOLATILE} for c in COMPARTMENTS],
    "principals": [{"name": p, "compartments": list(g)} for p, g in GRANTS.items()],
}
#: Like POLICY with grants and tiers that can't be meant.
BROKEN_POLICY = {
    "compartments": [*POLICY["compartments"], {"name": "odd", "tier": "secret", "volatile": False}, {"name": "lone", "tier": "department", "volatile": False}],
    "principals": [*POLICY["principals"], {"name": "p5", "compartments": ["lone", "nowhere"]}],
}
FAMILIES = {c: f"f{j // 4}" for j, c in enumerate(COMPARTMENTS)}
RUNS = [
    ("Qwen/Qwen3-1.7B", True, 4, 1024),
    ("Qwen/Qwen3-8B", True, 4, 1024),
    ("Qwen/Qwen3-8B", False, 1, 2048),
    ("meta-llama/Llama-3.3-70B-Instruct", True, 2, 4096),
    ("./local/folder", True, 4, 1024),
]
HARDWARE = {"vram": 8.6, "ram": 32.0, "ram_gbs": 50.0, "free_disk": 400.0}
WEIGHTS = [("s0", 1.0), ("s1", 0.5), ("s2", 0.25)]
LOSSES = [("a", 1, 2.0), ("a", 2, 1.5), ("a", 3, 1.7), ("a", 4, 2.4), ("b", 1, 1.0), ("b", 2, 0.9), ("b", 3, 0.8)]


def values(rows: list[tuple]) -> str:
    """Rows as SQL VALUES."""

    def one(v: object) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


def compartments_sql(policy: dict = POLICY) -> str:
    return f"comp(name, tier, volatile) AS (VALUES {values([(c['name'], c['tier'], c['volatile']) for c in policy['compartments']])})"


def grants_sql(policy: dict = POLICY) -> str:
    return f"grants(principal, compartment) AS (VALUES {values([(p['name'], c) for p in policy['principals'] for c in p['compartments']])})"


def people_sql(policy: dict = POLICY) -> str:
    return f"people(principal) AS (VALUES {values([(p['name'],) for p in policy['principals']])})"


def families_sql() -> str:
    return f"fam(compartment, family) AS (VALUES {values(list(FAMILIES.items()))})"
