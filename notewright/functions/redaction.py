"""Redaction: secrets and contact data, then denied terms, then the links they broke."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, WORD_END, WORD_START, WS, trimmed
from .values import LINK_SCHEME, PLACEHOLDERS

REDACTED = "[redacted]"

#: Stands for a dot before another dot while hosts are looked for. What a text itself holds of it, and of the
#: character that opens an escape, is escaped meanwhile, so every text comes back as it was.
HIDDEN, ESCAPE = "\uffff", "\ufffe"
ESCAPED_HIDDEN, ESCAPED_ESCAPE = ESCAPE + "\ufffd", ESCAPE + "\ufffc"


Rule = tuple[list[str], str, str]


def secret_rules(scheme: str = LINK_SCHEME) -> list[Rule]:
    """Literals one of which a match must hold, pattern, replacement; the order is part of the result.

    Loops over path folders are possessive and a host is one run of characters: Java's matcher
    recurses once per round of a plain group loop and overflows the stack on very long paths. A dot
    before another dot ends a host; ``_replaced`` hides it, so that the run can't cross it. An
    e-mail's local part starts only where its run of characters starts (or where the last match
    ended), which keeps a long run without ``@`` linear.
    """
    # --- fixed values: what is redacted, in order ------------------------------------------------
    return [
        (
            ["@"],
            rf"(?i)(?:\G|(?<![\w.+{HIDDEN}-]))[\w.+{HIDDEN}-]++@[\w-][\w.-]*\.[a-z]{{2,}}" + WORD_END,
            "[email]",
        ),
        ([":///"], rf"(?i)file:///[^{WS}]+", "[local path]"),
        (
            [":\\", ":/"],
            WORD_START + rf"[A-Za-z]:[\\/](?:[^\\/\n\"'`)\]]*+[\\/])*+[^{WS}\"'`)\]]*+",
            "[local path]",
        ),
        (
            ["/home/", "/Users/", "/mnt/", "/srv/"],
            rf"(?:^|[{WS}])/(?:home|Users|mnt|srv)/(?:[^/\n\"'`)\]]*+/)*+[^{WS}\"'`)\]]*+",
            " [local path]",
        ),
        (["eyJ"], WORD_START + r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", "[jwt]"),
        (
            ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
            WORD_START + r"gh[pousr]_[A-Za-z0-9]{16,}",
            "[github-token]",
        ),
        (["xox"], WORD_START + r"xox[baprs]-[A-Za-z0-9-]{10,}", "[slack-token]"),
        (["AKIA"], WORD_START + r"AKIA[0-9A-Z]{16}" + WORD_END, "[aws-key]"),
        (
            ["k-", "k_", "K-", "K_"],
            "(?i)" + WORD_START + r"(?:sk|pk|rk)[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{20,}",
            "[api-key]",
        ),
        (
            ["://"],
            WORD_START + rf"[A-Za-z][A-Za-z0-9+.-]*+://[^{WS}/@:]++:[^{WS}/@]++@[^{WS}]+",
            "[url-with-credentials]",
        ),
        (["://"], rf"(?i)\[([^\]]+)\]\([{WS}]*{scheme}://[^)]*\)", "$1"),
        (["://"], rf"(?i)\({scheme}://[^){WS}]+\)", ""),
        (["://"], rf"(?i){scheme}://[^{WS}]+", ""),
        (["+"], r"\+\d[\d \xA0().-]{7,}\d", "[phone]"),
        (["("], rf"\(\d{{2,3}}\)[{WS}]?\d{{4,5}}[- ]?\d{{4}}", "[phone]"),
    ]


def link_rules() -> list[Rule]:
    """Markdown left broken by the passes before."""
    labels = "|".join(PLACEHOLDERS)
    # --- fixed values: which links are repaired, in order ----------------------------------------
    return [
        (["]"], r"\[`?\[(?:local path|phone|email)\]`?\]\([^)]*\)?", REDACTED),
        (["]("], rf"\[([^\]]+)\]\([{WS}]*`?\[(?:local path|phone|email)\]`?[^)]*\)?", "$1"),
        (["]("], rf"\[([^\]]+)\]\([^){WS}]*\z", "$1"),
        (["["], rf"\[(?!(?:{labels})\])([^\]]+)\](?!\()", "$1"),
    ]


# Every rule above needs one of these, so a text without any of them is left alone.
_SUSPICIOUS = (
    r"[@:\[(+]|/(?:home|Users|mnt|srv)/|eyJ|gh[pousr]_|xox[baprs]-|AKIA|(?i:[spr]k[-_])"
)


def _raw(pattern: str) -> str:
    """A raw SQL string literal; a quote is written as its code, which patterns understand."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _replaced(pattern: str, replacement: str) -> str:
    """``regexp_replace`` on ``x``; patterns that know of hidden dots get them hidden and back."""
    if HIDDEN not in pattern:
        return f"regexp_replace(x, {_raw(pattern)}, '{replacement}')"

    escaped = f"replace(replace(x, '{ESCAPE}', '{ESCAPED_ESCAPE}'), '{HIDDEN}', '{ESCAPED_HIDDEN}')"
    hidden = f"regexp_replace({escaped}, r'\\.(?=\\.)', '{HIDDEN}')"
    found = f"replace(regexp_replace({hidden}, {_raw(pattern)}, '{replacement}'), '{HIDDEN}', '.')"
    back = f"replace(replace({found}, '{ESCAPED_HIDDEN}', '{HIDDEN}'), '{ESCAPED_ESCAPE}', '{ESCAPE}')"
    plain = f"regexp_replace(x, {_raw(pattern.replace(HIDDEN, ''))}, '{replacement}')"
    return f"CASE WHEN contains(x, '..') THEN {back} ELSE {plain} END"


def _apply(text: str, rules: list[Rule]) -> str:
    """The rules one after another. Each result is bound to a name, so it is worked out once, and a
    rule whose literals are missing costs no more than looking for them."""
    for needles, pattern, replacement in rules:
        held = " OR ".join(f"contains(x, r'{needle}')" for needle in needles)
        text = (
            f"transform(array({text}), x -> CASE WHEN {held} THEN "
            f"{_replaced(pattern, replacement)} ELSE x END)[0]"
        )
    return text


def _masked(text: str, terms: str) -> str:
    trimmed_term = f"btrim(t, '{SPACES}')"
    literal = rf"regexp_replace({trimmed_term}, r'[.*+?^$(){{}}|\[\]\\]', r'\\$0')"
    masked = f"regexp_replace(seen, concat('(?iu)', {literal}), '{REDACTED}')"
    fold = f"aggregate({terms}, {text}, (seen, t) -> CASE WHEN {trimmed_term} = '' THEN seen ELSE {masked} END)"
    return f"CASE WHEN size({terms}) > 0 THEN {fold} ELSE {text} END"


def redact_secrets(text: str, scheme: str = LINK_SCHEME) -> Column:
    return F.expr(_apply(text, secret_rules(scheme)))


def redact_denied(text: str, terms: str) -> Column:
    """Each term in list order, literally and in any case; later terms see earlier replacements."""
    return F.expr(_masked(text, terms))


def repair_links(text: str) -> Column:
    return F.expr(_apply(text, link_rules()))


def redact(text: str, terms: str | None = None, scheme: str = LINK_SCHEME) -> Column:
    """The whole chain over the column named ``text``.

    ``terms`` names the project's ordered ARRAY<STRING> of denied terms, if there is one. The chain
    is written as one SQL expression: built call by call it would cost more than planning it.
    """
    chain = _apply(text, secret_rules(scheme))
    worth = f"{text} rlike {_raw(_SUSPICIOUS)}"
    if terms is not None:
        chain = f"transform(array({chain}), x -> {_masked('x', terms)})[0]"
        worth += f" OR size({terms}) > 0"
    return F.expr(f"CASE WHEN {worth} THEN {_apply(chain, link_rules())} ELSE {text} END")


def mentions_denied(text: Column, terms: Column) -> Column:
    """True when the text holds any term as a substring, in any case; blank terms never match."""
    low = F.lower(text)
    return F.coalesce(
        F.exists(
            terms,
            lambda t: (trimmed(t) != "") & F.contains(low, F.lower(trimmed(t))),
        ),
        F.lit(False),
    )
