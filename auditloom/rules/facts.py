"""Rules on fact tables: price usages, derived addresses, struct fields.

Names, severities and CWE numbers are fixed values.
"""

from __future__ import annotations

from auditloom.rules.formula import (
    Equals, Has, ListHas, Matches, OneOf, Rule, SizeAtMost, Test, any_of, none_of, on,
)

#: Contexts in which a wrong price moves funds.
CRITICAL_CONTEXTS = ("Liquidation", "CollateralValuation", "BorrowingPower")
_CRITICAL = on("context", OneOf(CRITICAL_CONTEXTS))
_kind = lambda k: on("kind", Equals(k))
_valid = lambda v: on("validations", ListHas(v))


def _usage(name: str, severity: int, when: Test) -> Rule:
    return Rule(name, name, "Oracle Security", severity, None, when)


USAGE_RULES: tuple[Rule, ...] = (
    _usage("MissingStalenessCheck", 5, ~_valid("StalenessCheck") & ~_kind("Hardcoded") & _CRITICAL),
    _usage("MissingStalenessCheck", 4, ~_valid("StalenessCheck") & ~_kind("Hardcoded") & ~_CRITICAL),
    _usage("MissingConfidenceCheck", 4, _kind("Pyth") & ~_valid("ConfidenceCheck") & _CRITICAL),
    _usage("MissingConfidenceCheck", 3, _kind("Pyth") & ~_valid("ConfidenceCheck") & ~_CRITICAL),
    _usage("NoBoundsCheck", 3, ~_valid("BoundsCheck") & _CRITICAL),
    _usage("ManipulableSpotPrice", 5, _kind("AMMSpot")),
    _usage("HardcodedPrice", 4, _kind("Hardcoded")),
    _usage("AssumedStablecoinPrice", 3, on("asset", Matches("(?i)usdc|usdt|dai")) & _kind("Hardcoded")),
    _usage("SingleOracleDependency", 3, ~_valid("MultiOracleCheck") & _CRITICAL),
)

_entropy = lambda s: on("seed_sources", ListHas(s))
DERIVATION_RULES: tuple[Rule, ...] = tuple(Rule(n, n, "PDA Security", s, None, w) for n, s, w in (
    ("NonCanonicalBump", 5, on("bump_source", Equals("UserProvided"))),
    ("MissingBumpVerification", 4, on("bump_source", Equals("Unknown"))),
    ("ArbitraryProgramId", 5, on("program_id_source", Equals("UserProvided"))),
    ("LowEntropySeed", 3, ~_entropy("AccountKey") & ~_entropy("StateVariable") & on("seed_sources", SizeAtMost(1))),
))

#: Names of fields that hold an authority.
AUTHORITY_NAMES = ("authority", "admin", "owner", "governance", "governor", "payer", "creator", "manager", "operator",
                   "multisig", "signer", "fee_payer", "update_authority", "mint_authority", "freeze_authority",
                   "close_authority", "withdraw_authority", "vault_authority", "pool_authority", "dao_authority")
PDA_NAMES = ("pda", "vault", "pool", "config", "state", "escrow", "treasury")

_type = lambda t: on("field_type", t if isinstance(t, Test) else Has(t))
_attr = lambda t: on("attrs", t if isinstance(t, Test) else Has(t))
_name = lambda t: on("field_name", t)
_raw = _type("AccountInfo") & ~_type("Account<")
_seeds, _bump, _init = _attr("seeds"), _attr("bump"), _attr("init")
_signer = _type("Signer<") | _attr(Matches(r"#\[account\([^)]*\bsigner\b"))

FIELD_RULES: tuple[Rule, ...] = (
    Rule("SEC3-RAW", "Account Type Confusion", "AccountConfusion", 5, "CWE-345", _raw & ~_attr("CHECK") & ~_attr("#[account(")),
    Rule("SEC3-OWNER-RAW", "Missing Owner Check", "MissingOwnerCheck", 5, "CWE-284",
         _type("AccountInfo") & _type(none_of("Account<", "Program<", "Signer<", "SystemAccount<", "UncheckedAccount<")) & ~_attr("owner")),
    Rule("SEC3-OWNER", "Missing Owner Check", "MissingOwnerCheck", 4, "CWE-284",
         _type("UncheckedAccount<") & ~_attr(Matches(r"#\[account\([^)]*\bowner\b")) & ~_attr(Matches(r"(?i)///[^\n]*CHECK:?[^\n]*owner"))),
    Rule("SEC3-SIGNER", "Missing Signer Validation", "MissingSignerCheck", 5, "CWE-287",
         _name(Matches("(?i)" + "|".join(AUTHORITY_NAMES[:11]))) & ~_signer),
    Rule("SEC3-SEED", "Insecure PDA Derivation", "InsecurePDADerivation", 4, "CWE-330",
         _seeds & ~_attr(Matches(r"seeds\s*=\s*\[[^\]]*,[^\]]*\]")) & ~_attr('b"')),
    Rule("SEC3-BUMP", "Insecure PDA Derivation", "InsecurePDADerivation", 3, "CWE-330", _seeds & ~_bump & ~_init),
    Rule("SEC3-NOSEED", "Insecure PDA Derivation", "InsecurePDADerivation", 4, "CWE-330",
         _name(any_of(*PDA_NAMES)) & ~_seeds & _type("Account<")),
)

_typed = _type(any_of("Account <", "Account<", "Program <", "Program<", "Signer", "Sysvar", "SystemAccount"))
_plain_init = _init & ~_attr("init_if_needed")
_privileged = _name(Matches("(^|_)(authority|admin|owner|payer|signer|governance|manager|operator)$"))
_program = _name(Matches("program|^rent$"))

CONSTRAINT_RULES: tuple[Rule, ...] = (
    Rule("ANC-OWNER", "Missing Owner Check", "MissingOwnerCheck", 4, "CWE-284",
         ~_typed & _name(Has("account") & ~Has("system")) & ~_attr("owner")),
    Rule("ANC-WEAK", "Weak Account Constraint", "WeakConstraint", 3, "CWE-1188", _attr("constraint =") & ~_attr("@")),
    Rule("ANC-SPACE", "Missing Space Calculation", "MissingSpaceCalculation", 3, "CWE-770", _plain_init & ~_attr("space")),
    Rule("ANC-REINIT", "Reinitialization Vulnerability", "ReinitializationVulnerability", 5, "CWE-665", _attr("init_if_needed")),
    Rule("ANC-CLOSE", "Missing Close Guard", "MissingCloseGuard", 4, "CWE-404", _attr("close") & ~_attr("has_one")),
    Rule("ANC-BUMP", "Missing Bump Validation", "MissingBumpValidation", 4, "CWE-20", _seeds & ~_bump),
    Rule("ANC-BUMP-FIXED", "Missing Bump Validation", "MissingBumpValidation", 3, "CWE-20", _seeds & _attr(Matches(r"bump\s*=\s*[0-9]+"))),
    Rule("ANC-PDA-INIT", "Missing PDA Validation", "MissingPDAValidation", 4, "CWE-20",
         _type("Account<") & _type(none_of("TokenAccount", "Mint", "SystemProgram", "Token", "Rent", "Clock")) & ~_seeds & _init),
    Rule("ANC-PDA-STATIC", "Missing PDA Validation", "MissingPDAValidation", 3, "CWE-20",
         _seeds & _attr('b"') & _attr(none_of(".key()", "as_ref()", ".to_le_bytes()", "& ["))),
    Rule("ANC-SIGNER", "Missing Signer Check", "MissingSignerCheck", 5, "CWE-862",
         _privileged & _type(any_of("AccountInfo", "UncheckedAccount")) & ~_signer),
    Rule("ANC-HASONE", "Missing has_one Constraint", "MissingHasOne", 3, "CWE-862", _privileged & _signer & ~_attr("has_one")
         & on("siblings", ~Has("has_one"))),
    Rule("ANC-CPI", "Missing CPI Guard", "MissingCPIGuard", 5, "CWE-862",
         _program & ~_type(any_of("Program <", "Program<", "Sysvar <", "Sysvar<")) & _type(any_of("AccountInfo", "UncheckedAccount"))),
    Rule("ANC-UNCHECKED", "Unchecked Account Type", "UncheckedAccountType", 3, "CWE-843", _type("UncheckedAccount") & ~_attr("CHECK")),
    Rule("ANC-RENT", "Missing Rent Exemption", "MissingRentExemption", 2, "CWE-400", _init & ~_attr("payer")),
)

#: File-level checks of transfer hooks.
HOOK_RULES: tuple[Rule, ...] = (
    Rule("ANC-HOOK-META", "Invalid Token-2022 Transfer Hook", "InvalidTokenHook", 4, "CWE-20",
         any_of("TransferHook", "transfer_hook", "spl_transfer_hook") & none_of("extra_account_meta", "ExtraAccountMeta")),
    Rule("ANC-HOOK-AUTH", "Invalid Token-2022 Transfer Hook", "InvalidTokenHook", 3, "CWE-20",
         any_of("TransferHook", "transfer_hook") & Has("ctx.accounts") & any_of(".amount", ".balance", "transfer", "mint_to")
         & ~Matches(r"(hook_)?authority[^\n]*Signer")),
)
