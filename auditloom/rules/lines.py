"""Line rules: one finding per (rule, line).

Patterns, severities and CWE numbers are fixed values.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LineRule:
    id: str
    pattern: str
    category: str
    severity: int
    cwe: str


UNSAFE_CODE_RULES: tuple[LineRule, ...] = (
    LineRule("PTR-CONST", r"\*const\s+\w+", "RawPointer", 4, "CWE-822"),
    LineRule("PTR-MUT", r"\*mut\s+\w+", "RawPointer", 5, "CWE-822"),
    LineRule("PTR-AS", r"\.as_ptr\(\)", "RawPointer", 3, "CWE-822"),
    LineRule("PTR-AS-MUT", r"\.as_mut_ptr\(\)", "RawPointer", 4, "CWE-822"),
    LineRule("PTR-OFFSET", r"\.offset\(", "RawPointer", 5, "CWE-822"),
    LineRule("PTR-ADD", r"\.add\(", "RawPointer", 4, "CWE-822"),
    LineRule("PTR-PARTS", r"from_raw_parts(_mut)?\(", "RawPointer", 5, "CWE-822"),
    LineRule("PTR-NULL", r"null\(\)|null_mut\(\)", "RawPointer", 3, "CWE-822"),
    LineRule("PTR-READ", r"ptr::read(_volatile)?\(", "UnsafeDeref", 4, "CWE-476"),
    LineRule("PTR-WRITE", r"ptr::write(_volatile)?\(", "UnsafeDeref", 5, "CWE-476"),
    LineRule("CONV-TRANSMUTE", r"transmute\s*[:<(]", "TransmuteCall", 5, "CWE-704"),
    LineRule("CONV-TRANSMUTE-COPY", r"transmute_copy\s*[:<(]", "TransmuteCall", 5, "CWE-704"),
    LineRule("CONV-ASSUME-INIT", r"assume_init\s*\(", "TransmuteCall", 5, "CWE-704"),
    LineRule("CONV-FROM-RAW", r"from_raw\s*\(", "TransmuteCall", 4, "CWE-704"),
    LineRule("CONV-INTO-RAW", r"into_raw\s*\(", "TransmuteCall", 3, "CWE-704"),
    LineRule("CONV-ZEROED", r"zeroed\s*\(\)\s*\.\s*assume_init", "TransmuteCall", 4, "CWE-704"),
    LineRule("CONV-AS-PTR", r"\bas\s+\*(?:const|mut)\s", "TransmuteCall", 4, "CWE-704"),
    LineRule("LINK-ATTR", r"#\[link\(", "FFICall", 5, "CWE-111"),
    LineRule("LINK-NAME", r"#\[link_name", "FFICall", 4, "CWE-111"),
    LineRule("LINK-SYSTEM", r'extern\s+"system"', "FFICall", 4, "CWE-111"),
    LineRule("UNSAFE-IMPL", r"unsafe\s+impl\b", "UnsafeTrait", 4, "CWE-1021"),
    LineRule("UNION", r"^\s*(pub\s+)?union\s+\w+", "UnionType", 4, "CWE-843"),
    LineRule("ASM", r"\basm!\s*\(", "InlineAssembly", 5, "CWE-1242"),
)

#: Known incidents; every match has similarity 0.85, kept because it exceeds 0.7.
INCIDENT_RULES: tuple[LineRule, ...] = (
    LineRule("Wormhole Bridge", r"verify_signatures.*guardian.*without.*owner.*check", "MissingOwnerCheck", 5, "CWE-284"),
    LineRule("Cashio Stablecoin", r"mint_authority.*AccountInfo.*!.*Account<", "AccountConfusion", 5, "CWE-345"),
    LineRule("Saber Swap", r"amount.*\+.*fee.*without.*checked", "IntegerOverflow", 5, "CWE-190"),
    LineRule("Crema Finance", r"flash_loan.*callback.*without.*reentrancy.*guard", "ComplexReentrancy", 5, "CWE-841"),
)
INCIDENT_SIMILARITY = 0.85
INCIDENT_THRESHOLD = 0.7

COMMENT = r"^\s*(//|/\*|\*)"
FUNCTION_START = r"\bfn\s+(\w+)"
UNIT_START = r"^\s*(?:pub(?:\([a-z ]+\))?\s+)?(?:(?:async|const|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*(fn|struct)\s+(\w+)"
#: Lines that belong to the unit right below them: attributes and line comments.
UNIT_HEAD = r"^\s*(?:#!?\[|//)"
ACCOUNTS_STRUCT = r"derive\([^)]*\bAccounts\b"

#: Trigger and evidence of the neighbourhood rules: (trigger, evidence, first, last line offset).
CALL_TRIGGER = r"invoke\(|invoke_signed\(|program::invoke"
CALL_EVIDENCE = (r"(?i)require_keys_eq!.*program|program.*require_keys_eq!|assert_eq!.*key\(\)|key\(\).*assert_eq!"
                 r"|program::id\(\)|::id\(\).*assert|assert.*::id\(\)|program<'info")
REMAINING_TRIGGER = r"remaining_accounts"
REMAINING_EVIDENCE = (r"(?i)\.owner.*(require|assert|==)|(require|assert|==).*\.owner|try_from\(|try_deserialize"
                      r"|require_keys_eq!|key\(\) ==|is_signer.*require|require.*is_signer|account::try_from")
CLOSE_TRIGGER = r"(lamports\.borrow_mut\(\)|try_borrow_mut_lamports).*= 0|= 0.*(lamports\.borrow_mut\(\)|try_borrow_mut_lamports)"
CLOSE_EVIDENCE = (r"data\.borrow_mut\(\).*fill\(0\)|fill\(0\).*data\.borrow_mut\(\)|assign\(&system_program::ID\)"
                  r"|realloc\(0")
RAW_CONTEXT = r"CpiContext::new.*account_info|account_info.*CpiContext::new"
SAFETY_COMMENT = r"^\s*///? SAFETY:"
UNSAFE_BLOCK = r"\bunsafe\s*\{"
UNSAFE_FN = r"\bunsafe\s+fn\s+\w+"
DOMAIN_TOKENS = r"invoke|sol_memcpy|sol_memset|AccountInfo|from_raw_parts"

CALL_LINE = r"invoke\(|invoke_signed\(|invoke_signed_unchecked\(|CpiContext"
RETURN_LINE = r"Ok\(\(\)\)|return"
WRITE_LINE_TOKENS = r"\.balance|\.lamports|\.data|borrow_mut|set_"
