"""Text predicates and normalisers as SQL expressions.

Every function takes SQL text for its input (usually a column name) and returns SQL text, to
be used in ``selectExpr``, ``F.expr`` or a query.
"""

from __future__ import annotations

# Fixed value: the characters a Unicode-aware strip/split treats as whitespace.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _listed(characters: str) -> str:
    """A pattern class of low characters; one that lists them is a lookup, ranges are tried in turn."""
    return "[" + "".join(f"\\x{ord(c):02x}" for c in characters) + "]"


# Its characters in Latin 1 besides the blank, and the range of all others.
_LOW_BLANKS = _listed("".join(c for c in WHITESPACE if c != " " and c < "\u0100"))
_HIGH_BLANKS = r"[\u1680-\u3000]"

# Fixed value: control characters besides tab and line feed.
_CONTROL = _listed("".join(map(chr, [*range(0x09), *range(0x0B, 0x20), 0x7F])))

# Tokens that stand for "no value" in ordinary text columns.
PLACEHOLDERS = [
    "na", "n/a", "n.a.", "null", "none", "-", "--", "?", "unknown",
    "not available", "blank", "empty",
]

# Fixed value: a plain signed decimal number.
NUMERIC_LIKE = r"^-?\d+(\.\d+)?$"

# Fixed value: conservative e-mail shape, applied to lower-cased text.
EMAIL = (
    r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+"
    r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"
)


def raw(value: str) -> str:
    """A SQL string literal whose backslashes mean themselves."""
    return f'r"{value}"'


def literal(value: str) -> str:
    """A SQL string literal of any text, for names that come from data."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(c: str, values: list[str]) -> str:
    return f"({c} IN ({', '.join(raw(v) for v in values)}))"


def one_of_lowered(c: str, values: list[str]) -> str:
    """Whether a text is one of the lower-case values in any case; long texts are not lowered."""
    # a character takes four bytes at most
    longest = 4 * max(map(len, values))
    return f"(octet_length({c}) <= {longest} AND {one_of(f'lower({c})', values)})"


def column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def strip(c: str) -> str:
    # trimming by a set of characters costs much per character; plain padding goes first
    return f"btrim(btrim({c}), {raw(WHITESPACE)})"


def plain_blanks(c: str) -> str:
    """The text with every kind of white space as a plain blank."""
    # a class of low characters is cheap, a wide one is not: where a character of its range
    # occurs, characters are mapped one by one
    mapped = f"translate({c}, {raw(WHITESPACE)}, '{' ' * len(WHITESPACE)}')"
    return (f"CASE WHEN octet_length({c}) != length({c}) AND {c} RLIKE {raw(_HIGH_BLANKS)}"
            f" THEN {mapped} ELSE regexp_replace({c}, {raw(_LOW_BLANKS)}, ' ') END")


def single_blanks(c: str) -> str:
    """A text of plain blanks, each run of them as one and none around the text."""
    return f"btrim(regexp_replace({c}, ' {{2,}}', ' '))"


def collapse_whitespace(c: str) -> str:
    return single_blanks(plain_blanks(c))


def has_whitespace_issue(c: str) -> str:
    return f"({strip(c)} != {c} OR contains({plain_blanks(c)}, '  '))"


def is_blank(c: str) -> str:
    return f"({strip(c)} = '')"


def is_placeholder(c: str, stripped: bool = False) -> str:
    return one_of_lowered(c if stripped else strip(c), [*PLACEHOLDERS, ""])


def blank_to_null(c: str) -> str:
    return f"CASE WHEN {strip(c)} != '' THEN {c} END"


def spelling_key(c: str) -> str:
    return f"lower({collapse_whitespace(c)})"


def has_unicode_issue(c: str) -> str:
    # beyond ASCII exactly when a character takes more than one byte
    return f"(octet_length({c}) != length({c}) OR {c} RLIKE {raw(_CONTROL)})"


def is_numeric_like(c: str, stripped: bool = False) -> str:
    return f"({c if stripped else strip(c)} RLIKE {raw(NUMERIC_LIKE)})"


def is_multi_value(c: str) -> str:
    return f"({c} RLIKE '[,;|]')"


def clean_column_name(c: str) -> str:
    snake = f"regexp_replace({strip(c)}, '[^0-9a-zA-Z]+', '_')"
    return f"coalesce(nullif(lower(btrim({snake}, '_')), ''), 'column')"


def email_problem(c: str, stripped: bool = False) -> str:
    """Why a cell is not an e-mail address, or 'valid'; an address is never repaired."""
    text = c if stripped else strip(c)
    domain = f"substring_index({text}, '@', -1)"
    return (
        f"CASE WHEN {c} IS NULL OR {text} = '' THEN 'empty'"
        f" WHEN {text} RLIKE {raw('[ ' + chr(92) + 't]')} THEN 'whitespace'"
        f" WHEN length({text}) - length(replace({text}, '@', '')) != 1 THEN 'at_sign_count'"
        f" WHEN lower({text}) RLIKE {raw(EMAIL)} THEN 'valid'"
        f" WHEN startswith({text}, '@') THEN 'missing_local_part'"
        f" WHEN {domain} = '' THEN 'missing_domain'"
        f" WHEN NOT contains({domain}, '.') THEN 'no_top_level_domain'"
        f" ELSE 'pattern' END")


def validate_email(c: str) -> str:
    """struct(normalized, is_valid, reason)."""
    valid = f"({email_problem(c)}) = 'valid'"
    return (
        f"named_struct('normalized', CASE WHEN {valid} THEN lower({strip(c)}) END,"
        f" 'is_valid', {valid}, 'reason', {email_problem(c)})")


def email_key(c: str) -> str:
    return f"nullif(lower({strip(c)}), '')"


def phone_key(c: str) -> str:
    return f"nullif(regexp_replace({c}, {raw(chr(92) + 'D+')}, ''), '')"


def block_key(email: str | None, phone: str | None) -> str:
    """Blocking key over *normalised* e-mail and phone expressions."""
    keys = []
    if email is not None:
        keys.append(f"concat('email:', substring({email}, 1, 3))")
    if phone is not None:
        keys.append(f"concat('phone:', right({phone}, 6))")
    return f"coalesce({', '.join(keys)})"
