"""Column helpers for source text and finding labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from auditloom.rules import lines as L


def lines_of(text: Column) -> Column:
    """Lines without terminators; a final newline adds no empty line, empty text has no lines.

    Only the last terminator goes: ``$`` would also match before it, and so take an empty last line with it.
    """
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\r?\n"))


def strip_comments(text: Column) -> Column:
    """Drop ``/* */`` and ``//`` comments."""
    return F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", "")


def is_code_line(line: Column) -> Column:
    """Neither blank nor a comment line."""
    return ~line.rlike(L.COMMENT) & (F.trim(line) != "")


def fingerprint(*parts: Column, sep: str = ":") -> Column:
    return F.sha2(F.concat_ws(sep, *[p.cast("string") for p in parts]), 256)


def short_id(prefix: str, hexdigest: Column, n: int = 8, upper: bool = False) -> Column:
    head = F.substring(hexdigest, 1, n)
    return F.concat(F.lit(prefix + "-"), F.upper(head) if upper else head)


def snake_name(name: Column) -> Column:
    """Instruction name of an accounts struct: ``InitVaultAccounts`` -> ``init_vault``."""
    stem = name
    for suffix in ("Accounts", "Context", "Ctx"):
        stem = F.regexp_replace(stem, f"({suffix})+$", "")
    snake = F.lower(F.regexp_replace(stem, r"(.)([A-Z])", "$1_$2"))
    # adjacent capitals need a second pass because matches do not overlap
    snake2 = F.lower(F.regexp_replace(F.regexp_replace(stem, r"(.)([A-Z])", "$1_$2"), r"([A-Z])([A-Z])", "$1_$2"))
    return F.when(stem == "", F.lower(name)).otherwise(F.coalesce(snake2, snake))


def field_name(line: Column) -> Column:
    """``pub vault: Account<..>`` -> ``vault``; null without a colon."""
    head = F.trim(F.element_at(F.split(line, ":"), 1))
    return F.when(F.contains(line, F.lit(":")) & (head != ""), F.element_at(F.split(head, r"\s+"), -1))


def context_struct(code: Column) -> Column:
    """Name of the accounts struct in ``Context<..>``; empty when there is none."""
    inner = F.regexp_extract(code, r"Context\s*<([^>]*)>", 1)
    return F.regexp_extract(F.trim(F.element_at(F.split(inner, ","), -1)), r"^[A-Z]\w*", 0)


#: Severity labels by ordinal.
SEVERITY_LABELS = {1: "INFO", 2: "LOW", 3: "MEDIUM", 4: "HIGH", 5: "CRITICAL"}


def severity_label(ordinal: Column) -> Column:
    out = F.lit("MEDIUM")
    for n, label in SEVERITY_LABELS.items():
        out = F.when(ordinal == n, label).otherwise(out)
    return out


def severity_ordinal(label: Column) -> Column:
    """Ordinal of a label in any case; unknown labels count as medium."""
    up = F.upper(F.trim(label))
    out = F.lit(3)
    for n, name in SEVERITY_LABELS.items():
        out = F.when(up == name, n).otherwise(out)
    return out


def first_match(text: Column, cases: list[tuple[tuple[str, ...], str]], default: Column) -> Column:
    """First case one of whose tokens occurs in ``text``."""
    out = None
    for tokens, value in cases:
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in tokens])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


#: Taxonomy by words of the finding type, tried in this order, then by category.
TYPE_WORDS: list[tuple[tuple[str, ...], str]] = [
    (("Signer",), "MissingSignerCheck"),
    (("Owner", "Cosplay"), "MissingOwnerCheck"),
    (("Overflow", "overflow", "Arithmetic", "Precision"), "IntegerOverflow"),
    (("Reentrancy", "reentrancy"), "Reentrancy"),
    (("CPI", "cpi", "Cross-Program"), "ArbitraryCPI"),
    (("Oracle", "oracle", "Price"), "OracleManipulation"),
    (("PDA", "Bump", "Seed"), "ArbitraryCPI"),
    (("Pause", "Event", "Hardcoded"), "UninitializedData"),
]
CATEGORY_TAXONOMY: dict[str, str] = {
    "Authentication": "MissingSignerCheck",
    "Authorization": "MissingSignerCheck",
    "Arithmetic": "IntegerOverflow",
    "CPI Security": "ArbitraryCPI",
    "Account Validation": "MissingOwnerCheck",
    "Account validation": "MissingOwnerCheck",
    "PDA Security": "ArbitraryCPI",
    "PDA security": "ArbitraryCPI",
    "Token Security": "MissingOwnerCheck",
    "Token security": "MissingOwnerCheck",
    "DeFi Attacks": "OracleManipulation",
    "DeFi attacks": "OracleManipulation",
    "Protocol Safety": "MissingSignerCheck",
    "Code Quality": "MissingSignerCheck",
}


def taxonomy(vuln_type: Column, category: Column) -> Column:
    by_category = F.lit("UninitializedData")
    for name, tax in CATEGORY_TAXONOMY.items():
        by_category = F.when(category == name, tax).otherwise(by_category)
    return first_match(vuln_type, TYPE_WORDS, by_category)


#: Hosts taken as source hosting without further evidence.
GIT_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "git.sr.ht", "gitea.com")


def classify_target(target: Column) -> tuple[Column, Column]:
    """(kind, normalised target) with kind ``git``, ``address`` or ``path``."""
    ssh = target.rlike(r"^git@[^:]*:")
    ssh_url = F.concat(F.lit("https://"), F.regexp_extract(target, r"^(?:git@)+([^:]*):", 1), F.lit("/"),
                       F.regexp_replace(F.regexp_extract(target, r"^git@[^:]*:(.*)$", 1), "/+$", ""))
    host = F.regexp_extract(target, r"^https?://([^/]*)", 1)
    looks_git = target.rlike(r"\.git$|\.git/|/tree/|/blob/")
    web = target.rlike("^https?://") & (host.isin(*GIT_HOSTS) | looks_git)
    cut = F.when(F.contains(target, F.lit("/tree/")), F.substring_index(target, "/tree/", 1)).when(
        F.contains(target, F.lit("/blob/")), F.substring_index(target, "/blob/", 1)).otherwise(target)
    web_url = F.regexp_replace(cut, "/+$", "")
    dotgit = lambda u: F.when(F.endswith(u, F.lit(".git")), u).otherwise(F.concat(u, F.lit(".git")))
    address = target.rlike("^[A-Za-z0-9]{32,44}$")
    kind = F.when(ssh | web, "git").when(address, "address").otherwise("path")
    value = F.when(ssh, dotgit(ssh_url)).when(web, dotgit(web_url)).otherwise(target)
    return kind, value


VOTE_SCHEMA = "verdict string, confidence double, reasoning string"


def extract_vote(text: Column) -> Column:
    """Vote embedded in prose as ``{..}``; a row without usable JSON gets ``error`` set."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = F.from_json(F.when(body != "", body), VOTE_SCHEMA)
    usable = (body != "") & F.try_parse_json(body).isNotNull()
    verdict = F.upper(parsed["verdict"])
    return F.struct(
        F.when(usable, F.when(verdict == "CONFIRMED", "Confirmed").when(verdict == "REJECTED", "Rejected")
               .otherwise("Uncertain")).alias("verdict"),
        F.when(usable, F.coalesce(parsed["confidence"], F.lit(0.5))).alias("confidence"),
        F.when(usable, F.coalesce(parsed["reasoning"], F.lit("No reasoning provided"))).alias("reasoning"),
        F.when(body == "", "no JSON").when(~usable, "bad JSON").alias("error"),
    )


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` placeholders from columns."""
    out = F.lit(template)
    for name, col in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col.cast("string"), F.lit("")))
    return out


def statement_stats(code: Column) -> dict[str, Column]:
    """Counts of arithmetic, checked arithmetic and assignments in a unit."""
    return {
        "arithmetic": F.regexp_count(code, F.lit(r" [-+*/%] | [-+*/%]= ")),
        "checked_arithmetic": F.regexp_count(code, F.lit(r"\.(checked|saturating|wrapping)_(add|sub|mul|div)\(")),
        "assignments": F.regexp_count(code, F.lit(r"[^=!<>+\-*/%]=[^=>]|[-+*/%]= ")),
    }
