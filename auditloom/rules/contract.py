"""Unit rules for on-chain program source.

The tokens, severities and CWE numbers below are fixed values: results depend on them exactly.
"""

from __future__ import annotations

from auditloom.rules.formula import (
    NOT_TEST, Any, AtLeast, Count, Has, Matches, Rule, SomeLine, all_of, any_of, none_of,
)

_CALL = any_of("invoke(", "invoke_signed(")
_SIGNED = Has("Signer")

UNIT_RULES: tuple[Rule, ...] = (
    Rule("SOL-001", "Missing Signer Check", "Authentication", 5, "CWE-287",
         NOT_TEST & Has("AccountInfo<") & any_of("authority", "admin", "owner") & Has("fn ")
         & none_of("Signer<", "#[account(signer)]", "is_signer", ".signer", "has_one", "constraint =", "seeds =",
                   "require_keys_eq", "access_control")),
    Rule("SOL-002", "Integer Overflow/Underflow", "Arithmetic", 4, "CWE-190",
         NOT_TEST & any_of(" + ", " - ", " * ") & any_of("u64", "u128", "i64")
         & any_of("amount", "balance", "supply", "fee", "reward", "deposit", "withdraw", "lamport", "stake")
         & none_of("checked_", "saturating_", "overflow-checks", ".ok_or(", "try_into", "as u128", "safe_math",
                   "SafeMath")),
    Rule("SOL-003", "Missing Owner Check", "Authorization", 5, "CWE-285",
         NOT_TEST & Has("AccountInfo<") & any_of("try_borrow_data", "data.borrow()")
         & none_of("owner ==", ".owner", "constraint =", "has_one", "Account<", "Program<", "check_program_account",
                   "require_keys_eq")),
    Rule("SOL-004", "Type Cosplay", "Account Validation", 5, "CWE-843",
         NOT_TEST & ((any_of("try_from_slice", "deserialize(") & none_of("discriminator", "DISCRIMINATOR", "Account<"))
                     | (Has("try_borrow_data") & none_of("discriminator", "Account<", "AccountDeserialize")))),
    Rule("SOL-005", "Arbitrary CPI", "CPI Security", 5, "CWE-20",
         NOT_TEST & _CALL
         & none_of("program.key()", "program_id ==", "check_program_account", "Program<", "token::ID",
                   "system_program::ID", "Token::id()", "spl_token::id()", "anchor_spl", "token_program",
                   "system_program", "CpiContext::new", "constraint =")),
    Rule("SOL-006", "Duplicate Mutable Accounts", "Account Validation", 4, "CWE-20",
         NOT_TEST
         & Any((Count("Account<'info, TokenAccount>", 2), Count("Account < 'info , TokenAccount >", 2),
                Count("AccountInfo<'info>", 3)))
         & Has("#[account(mut") & none_of(".key() !=", "key() != ", "constraint =", "has_one")),
    Rule("SOL-007", "Bump Seed Canonicalization", "PDA Security", 4, "CWE-330",
         NOT_TEST & ((Has("create_program_address") & ~Has("find_program_address"))
                     | (Has("seeds = [") & none_of("bump", "init,")
                        & none_of("bump =", "bump,", ".bump", "seeds::program")))),
    Rule("SOL-008", "PDA Sharing", "PDA Security", 4, "CWE-284",
         NOT_TEST & Has("seeds = [")
         & any_of("user_state", "user_account", "user_position", "escrow", "user_balance")
         & none_of("user.key()", "payer.key()", "authority.key()", "owner.key()", "signer.key()")),
    Rule("SOL-009", "Closing Accounts", "Account Management", 4, "CWE-404",
         NOT_TEST & any_of("set_lamports(0)", "lamports.borrow_mut") & ~Has("close =")
         & none_of("data.fill(0)", "CLOSED_ACCOUNT_DISCRIMINATOR")),
    Rule("SOL-010", "Sysvar Address", "Sysvar Security", 3, "CWE-20",
         NOT_TEST & Has("AccountInfo") & any_of("Clock", "Rent", "SlotHashes") & none_of("Sysvar<", "Sysvar <")
         & none_of("sysvar::", "SYSVAR_", "clock::id()", "rent::id()")),
    Rule("SOL-011", "Re-initialization", "Initialization", 4, "CWE-665",
         NOT_TEST & any_of("fn initialize", "fn init(", "fn process_initialize", "Initialize {")
         & none_of("is_initialized", "initialized ==", "#[account(init", "require!(!state.initialized")),
    Rule("SOL-012", "Account Data Mismatch", "Account Validation", 4, "CWE-20",
         NOT_TEST & any_of("vault", "pool", "market") & Has("Account<") & any_of("authority", "user", "owner")
         & none_of("has_one", "constraint =", ".authority ==", ".owner ==", "vault.authority")),
    Rule("SOL-013", "Missing Rent Exemption", "Account Management", 3, "CWE-754",
         NOT_TEST & any_of("create_account", "CreateAccount") & ~Has("#[account(init")
         & none_of("rent_exempt", "Rent::get", "minimum_balance")),
    Rule("SOL-014", "Unsafe Deserialization", "Data Validation", 4, "CWE-502",
         Has("try_from_slice_unchecked") | (Has("from_slice") & ~Has("try_from"))),
    Rule("SOL-015", "Missing Program ID Check", "CPI Security", 5, "CWE-345",
         NOT_TEST & Has("CpiContext") & all_of("program:", "AccountInfo")
         & none_of("program_id ==", "key() ==", "Program<", "Program <", "token::ID", "Token::id()")),
    Rule("SOL-016", "Unchecked Return Value", "Error Handling", 4, "CWE-252",
         NOT_TEST & ((_CALL & Has(".unwrap()") & ~Has("// safe:")) | all_of("try_borrow", ".unwrap()"))
         & any_of("transfer", "withdraw", "deposit") & none_of("?", ".ok_or(", ".map_err(")),
    Rule("SOL-017", "Reentrancy", "Reentrancy", 5, "CWE-841",
         any_of("invoke", "CpiContext") & all_of("borrow_mut", "invoke") & none_of("ReentrancyGuard", "is_locked")),
    Rule("SOL-018", "Flash Loan Attack", "DeFi Security", 5, "CWE-362",
         any_of("flash_loan", "FlashLoan") & none_of("require!", "assert!")),
    Rule("SOL-019", "Oracle Manipulation", "Oracle Security", 5, "CWE-20",
         any_of("oracle", "price_feed", "Pyth", "Switchboard") & none_of("twap", "median")
         & none_of("max_price", "min_price")),
    Rule("SOL-020", "Stale Price", "Oracle Security", 4, "CWE-672",
         (any_of("price_feed", "oracle_account", "PriceFeed", "Pyth", "Switchboard", "get_price")
          | all_of("oracle", "AccountInfo"))
         & none_of("timestamp", "stale", "last_update", "age", "max_staleness", "publish_time")),
    Rule("SOL-021", "Missing Mint Authority", "Token Security", 5, "CWE-269",
         any_of("mint_to", "MintTo") & ~all_of("mint_authority", "Signer")),
    Rule("SOL-022", "Missing Freeze Authority", "Token Security", 4, "CWE-269",
         NOT_TEST & any_of("freeze_account", "FreezeAccount", "token::freeze", "thaw_account")
         & ~(all_of("freeze_authority", "Signer") | any_of("has_one = freeze_authority", "Program<"))),
    Rule("SOL-023", "Token Account Confusion", "Token Security", 4, "CWE-843",
         any_of("TokenAccount", "token::Token") & Has("transfer") & none_of("token_account.mint ==", "constraint = ")),
    Rule("SOL-024", "Missing Token Program Check", "Token Security", 4, "CWE-345",
         NOT_TEST & any_of("token::transfer", "token::Transfer", "transfer_checked", "mint_to", "burn")
         & any_of("CpiContext", "invoke") & none_of("Program<", "token_program", "Token::id()")),
    Rule("SOL-025", "Lamport Drain", "Account Management", 5, "CWE-682",
         NOT_TEST & any_of("lamports.borrow_mut", "set_lamports")
         & none_of("rent_exempt", "minimum_balance", "Rent::get") & none_of("Signer", "authority", "require!")),
    Rule("SOL-026", "Recursive CPI", "CPI Security", 3, "CWE-674",
         any_of("process_instruction", "fn execute_hook", "fn transfer_hook") & _CALL & all_of("program_id", "invoke")),
    Rule("SOL-027", "Missing Seeds Validation", "PDA Security", 4, "CWE-20",
         any_of("find_program_address", "seeds =") & any_of("user.key()", "ctx.accounts.") & none_of("bump =", "bump,")),
    Rule("SOL-028", "Account Resurrection", "Account Management", 4, "CWE-672",
         NOT_TEST & any_of("close_account", "lamports.borrow_mut", "set_lamports(0)") & ~Has("#[account(close")
         & none_of("fill(0)", "CLOSED_ACCOUNT_DISCRIMINATOR")),
    Rule("SOL-029", "Missing Close Authority", "Authorization", 4, "CWE-285",
         NOT_TEST & any_of("close =", "close_account")
         & ~((any_of("authority", "admin", "owner") & _SIGNED) | any_of("has_one", "#[account(signer)]", "require!"))),
    Rule("SOL-030", "Privilege Escalation", "Authorization", 5, "CWE-269",
         NOT_TEST & (Has("set_authority") | all_of("authority", "= ctx.accounts.", ".key()"))
         & ~(any_of("current_authority", "has_one = authority") & any_of("Signer<", "#[account(signer)]"))),
    Rule("SOL-031", "Unauthorized Mint", "Token Security", 5, "CWE-269",
         NOT_TEST & any_of("mint_to", "MintTo") & ~(any_of("mint_authority", "authority") & any_of("Signer", "has_one"))
         & none_of("require!", "#[access_control")),
    Rule("SOL-032", "Missing Decimals Check", "Token Security", 3, "CWE-682",
         all_of("amount", "transfer", "u64") & none_of("decimals", "10.pow")),
    Rule("SOL-033", "Missing Slippage Protection", "DeFi Security", 4, "CWE-20",
         any_of("swap", "exchange") & none_of("slippage", "min_amount", "max_amount")),
    Rule("SOL-034", "Sandwich Attack", "MEV Protection", 4, "CWE-362",
         NOT_TEST & Has("pool") & any_of("add_liquidity", "remove_liquidity", "provide_liquidity")
         & none_of("deadline", "slippage", "min_amount", "max_amount")),
    Rule("SOL-035", "Front-Running", "MEV Protection", 4, "CWE-362",
         NOT_TEST & (any_of("fn bid", "fn reveal") | all_of("auction", "bid"))
         & ~(any_of("commit_reveal", "CommitReveal") | all_of("commit_hash", "reveal")
             | (Has("hash") & any_of("commit", "seal")))),
    Rule("SOL-036", "Missing Amount Validation", "Input Validation", 4, "CWE-20",
         NOT_TEST & any_of("transfer", "withdraw", "send") & any_of("CpiContext", "invoke", "borrow_mut")
         & any_of("amount:", "amount,")
         & none_of("amount >", "amount >=", "amount !=", "require!(", "amount.checked", "ensure!")),
    Rule("SOL-037", "Division Before Multiplication", "Arithmetic", 3, "CWE-682",
         NOT_TEST & any_of("amount", "balance", "price", "rate", "fee", "reward")
         & SomeLine(r"\S.* / .* \* .*\S")),
    Rule("SOL-038", "Precision Loss", "Arithmetic", 4, "CWE-682",
         all_of("/", "u64", "rate") & none_of("Decimal", "U256", "u128")),
    Rule("SOL-039", "Rounding Error", "Arithmetic", 3, "CWE-682",
         any_of("shares", "pool_tokens") & Has("/") & none_of("round_up", "ceil")),
    Rule("SOL-040", "Missing Zero Check", "Arithmetic", 3, "CWE-369",
         NOT_TEST & Has(" / ")
         & any_of("supply", "total_shares", "denominator", "divisor", "pool_balance", "total_staked")
         & none_of("!= 0", "> 0", "require!", "assert!", ".checked_div")),
    Rule("SOL-041", "Unrestricted Transfer", "Authorization", 5, "CWE-285",
         NOT_TEST & (any_of("token::transfer", "system_instruction::transfer")
                     | (Has("transfer(") & any_of("CpiContext", "invoke")))
         & none_of("Signer", "authority", "admin", "owner", "require!", "is_signer", "#[account(signer)]", "has_one",
                   "seeds =", "constraint =", "invoke_signed", "payer", "signer_seeds", "access_control")),
    Rule("SOL-042", "Missing Pause Mechanism", "Protocol Safety", 1, "CWE-754",
         NOT_TEST & all_of("pub fn ", "Context<")
         & AtLeast(3, tuple(Has(t) for t in ("swap", "deposit", "withdraw", "pool", "vault", "liquidity", "stake",
                                              "lend")))
         & none_of("paused", "is_active", "emergency", "frozen", "halt", "enabled", "disabled", "state.active",
                   "is_paused")),
    Rule("SOL-043", "Hardcoded Address", "Code Quality", 1, "CWE-798",
         NOT_TEST & any_of("Pubkey::from_str(", "pubkey!(", "declare_id!(")
         & any_of("admin", "fee_recipient", "treasury", "oracle_address")
         & none_of("system_program", "spl_token", "token_program", "associated_token", "declare_id")),
    Rule("SOL-044", "Missing Event Emission", "Observability", 2, None,
         NOT_TEST & any_of("transfer", "deposit", "withdraw") & any_of("borrow_mut", "CpiContext", "invoke")
         & none_of("emit!", "msg!", "#[event]", "Event ", "log_instruction", "sol_log", "emit_cpi")),
    Rule("SOL-045", "Unsafe Exponent", "Arithmetic", 4, "CWE-190",
         NOT_TEST & Has("pow(") & any_of("u64", "u128", "i64") & none_of("checked_pow", "saturating_pow", "overflow")),
    Rule("SOL-046", "Time Manipulation", "Time Safety", 3, "CWE-367",
         any_of("Clock::get", "unix_timestamp") & any_of("lock", "vest", "deadline") & none_of("buffer", "tolerance")),
    Rule("SOL-047", "Missing Access Control", "Authorization", 5, "CWE-862",
         NOT_TEST & any_of("borrow_mut", "set_") & any_of("authority", "admin", "owner")
         & none_of("Signer<", "require!", "has_one", "constraint =", "seeds =", "#[account(", "access_control",
                   "require_keys_eq", "is_signer", "key() ==")),
    Rule("SOL-048", "Account Hijacking", "Account Security", 5, "CWE-287",
         NOT_TEST & Has("create_account")
         & none_of("seeds =", "find_program_address", "#[account(init", "create_program_address",
                   "Pubkey::create_with_seed", "system_instruction::create_account")),
    Rule("SOL-049", "LP Manipulation", "DeFi Security", 4, "CWE-682",
         any_of("lp_token", "pool_token", "shares") & Has("mint") & none_of("k_before", "invariant", "constant_product")),
    Rule("SOL-050", "Unsafe Reward Calculation", "DeFi Security", 4, "CWE-682",
         any_of("reward", "stake") & any_of("timestamp", "duration") & ~all_of("elapsed", "checked")),
    Rule("SOL-051", "Missing Deadline", "Transaction Safety", 3, "CWE-367",
         any_of("swap", "trade") & none_of("deadline", "expires")),
    Rule("SOL-052", "Governance Attack", "Governance", 4, "CWE-284",
         NOT_TEST & (all_of("proposal", "fn vote")
                     | (Has("governance") & any_of("execute_proposal", "cast_vote"))
                     | any_of("fn create_proposal", "fn execute_proposal"))
         & (none_of("timelock", "execution_delay", "cooldown_period") | none_of("quorum", "threshold", "min_votes"))),
)

#: Further unit rules: raw memory and call order (F25) and guard tokens (F14).
EXTRA_UNIT_RULES: tuple[Rule, ...] = (
    Rule("UNIT-CAST", "Narrowing Cast On Amount", "Integer Overflow", 4, "CWE-190",
         Has("as u64") & any_of("amount", "balance", "lamports") & none_of("checked_", "saturating_")),
    Rule("UNIT-DESER", "Deserialize Without Validation", "Uninitialized Data", 4, "CWE-665",
         any_of("try_from_slice", "unpack") & none_of("validate", "is_initialized")),
    Rule("UNIT-MEM", "Raw Memory Copy Without Bounds", "Memory Safety", 5, "CWE-119",
         any_of("unsafe", "ptr::") & any_of("copy", "write_bytes", "read_unaligned") & none_of("len()", "bounds")),
    Rule("UNIT-ORDER", "Call Followed By Write", "Reentrancy Pattern", 4, "CWE-841",
         all_of("invoke", "program_id") & none_of("reentrancy", "is_locked", "guard")
         & Matches("(?s)invoke.*(serialize|pack_into|borrow_mut)")),
    Rule("UNIT-EXT", "Unchecked External Data", "Unchecked External Data", 4, "CWE-20",
         any_of("account_info", "AccountInfo") & Has("data") & any_of("memcpy", "copy_from_slice")
         & none_of("check", "validate")),
    Rule("REEN-UNGUARDED", "Unguarded CPI", "Reentrancy", 4, "CWE-841",
         _CALL & none_of("ReentrancyGuard", "reentrancy", "entered", "locked")
         & none_of("11111111111111111111111111111111", "TokenkegQfeZyiNwAJbNbGKPFXCWuBvf9Ss623VQ5DA",
                   "TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb", "ATokenGPvbdGVxr1b2hvZbsiqW5xWH25efTNsLJA8knL",
                   "system_program", "token_program")),
    Rule("REEN-CALLBACK", "Callback Reentrancy", "Reentrancy", 4, "CWE-841",
         any_of("callback", "on_complete") & Has("invoke")),
    Rule("REEN-LOAN", "Flash Loan Reentrancy", "Reentrancy", 5, "CWE-841",
         (any_of("flash_loan", "FlashLoan") | all_of("borrow", "repay")) & none_of("require!", "assert!", "constraint")),
    Rule("REEN-LOAN-CHECKED", "Flash Loan Reentrancy", "Reentrancy", 3, "CWE-841",
         (any_of("flash_loan", "FlashLoan") | all_of("borrow", "repay")) & any_of("require!", "assert!", "constraint")),
)

#: File-level invariants with a fixed confidence (F12).  ``note`` is the expression; a rule whose
#: id ends in ``?`` carries a counterexample.
INVARIANT_RULES: tuple[Rule, ...] = (
    Rule("BC-transfer", "from.balance + to.balance == TOTAL_BEFORE", "BalanceConservation", 4, None,
         Has("transfer") & any_of("from", "to"), confidence=0.9),
    Rule("BC-withdraw", "withdraw_amount <= account.balance", "BalanceConservation", 4, None,
         any_of("withdraw", "redeem"), confidence=0.95),
    Rule("BC-deposit", "balance_after >= balance_before", "BalanceConservation", 3, None,
         any_of("deposit", "stake"), confidence=0.85),
    Rule("AC-signed", "msg.sender == account.authority", "AccessControl", 4, None,
         any_of("authority", "owner") & Has("Signer<"), confidence=0.95),
    Rule("AC-unsigned?", "authority MUST BE Signer", "AccessControl", 5, None,
         any_of("authority", "owner") & ~Has("Signer<"), confidence=0.6,
         note="Authority used without Signer constraint"),
    Rule("AR-checked", "result in [0, u64::MAX]", "ArithmeticBounds", 2, None,
         any_of("u64", "u128") & any_of("checked_add", "checked_sub", "checked_mul", "checked_div", "saturating_add",
                                        "saturating_sub"), confidence=0.9),
    Rule("AR-unchecked?", "result SHOULD BE in [0, u64::MAX]", "ArithmeticBounds", 4, None,
         any_of("u64", "u128") & none_of("checked_add", "checked_sub", "checked_mul", "checked_div", "saturating_add",
                                         "saturating_sub"), confidence=0.5, note="Unchecked arithmetic detected"),
    Rule("ST-init", "initialized: false -> true (one-way)", "StateTransition", 3, None,
         Has("initialized"), confidence=0.85),
    Rule("ST-pause", "if paused then no_operations()", "StateTransition", 3, None,
         any_of("paused", "frozen"), confidence=0.8),
)

#: Signals of one unit, own text only (F28); the context struct adds its own signals.
UNIT_SIGNALS: dict[str, object] = {
    "signer_check": any_of("is_signer", "Signer", "has_one", "constraint", "require_keys_eq!", "account(signer",
                           "authority", ".key()"),
    "owner_check": any_of("owner", "Owner", "has_one", "constraint", "Account<"),
    "pda_check": any_of("find_program_address", "create_program_address", "seeds =", "bump =", "account(seeds"),
    "checked_math": any_of("checked_add", "checked_sub", "checked_mul", "checked_div", "saturating_add",
                           "saturating_sub", "saturating_mul", "overflowing_add", "overflowing_sub"),
    "raw_math": any_of(" + ", " - ", " * ", " / ", "+= ", "-= ", "*= ", "/= "),
}

