"""The secret-rule catalogue and its translation to Java regular expressions."""

from __future__ import annotations

from dataclasses import dataclass

# Every character the scanner's rule language treats as white space: the value
# of ``\s`` and what trimming strips.
WHITE_SPACE = "".join(
    map(
        chr,
        (
            *range(0x09, 0x0E),
            0x20,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
            0xFEFF,
        ),
    )
)


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``regex`` is in the rule language: ASCII ``\\b``, Unicode ``\\s``.
    ``group`` is the capture group holding the secret (0: the whole match).
    ``hints`` are literals of which at least one occurs in every match; a text
    without any is never handed to the regex engine.  With ``ignore_case`` they
    are compared with the lower-cased text.  No hints: always run the regex.
    ``lead`` is a regex of how every match begins, if known: at most places of a
    text it fails sooner than the look-arounds of ``\\b``, and it changes no match.
    """

    id: str
    name: str
    regex: str
    group: int = 0
    min_entropy: float | None = None
    ignore_case: bool = False
    hints: tuple[str, ...] = ()
    lead: str = ""


# Identifiers, names, patterns, capture groups and entropy floors
# must equal these for results to agree; the order is the order of application.
RULES: tuple[Rule, ...] = (
    Rule(
        "aws-access-key",
        "AWS Access Key ID",
        r"\b(A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}\b",
        hints=("A3T", "AKIA", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "ASIA"),
        lead=r"A[3GIKNRS]",
    ),
    Rule(
        "aws-secret-key",
        "AWS Secret Access Key",
        r"""(?:aws_secret_access_key|aws_sec_key|secret_key)\s*[:=]\s*["']?([A-Za-z0-9/+=]{40})["']?""",
        group=1,
        min_entropy=4.2,
        ignore_case=True,
        hints=("aws_sec", "secret_key"),
    ),
    Rule(
        "github-pat",
        "GitHub Personal Access Token",
        r"\b(gh[pousr]_[A-Za-z0-9_]{36,255}|github_pat_[A-Za-z0-9_]{22}_[A-Za-z0-9_]{59})\b",
        hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
        lead=r"g(?:h[pousr]_|ithub_pat_)",
    ),
    Rule(
        "openai-api-key",
        "OpenAI API Key",
        r"\b(sk-(?:proj-|svcacct-)?[a-zA-Z0-9_-]{32,100})\b",
        hints=("sk-",),
        lead=r"sk-",
    ),
    Rule(
        "anthropic-api-key",
        "Anthropic API Key",
        r"\b(sk-ant-[a-zA-Z0-9_-]{32,120})\b",
        hints=("sk-ant-",),
        lead=r"sk-ant-",
    ),
    Rule(
        "google-api-key",
        "Google API Key",
        r"\b(AIza[0-9A-Za-z\-_]{35})\b",
        hints=("AIza",),
        lead=r"AIza",
    ),
    Rule(
        "stripe-secret-key",
        "Stripe Secret Key",
        r"\b([sr]k_live_[0-9a-zA-Z]{24,99})\b",
        hints=("k_live_",),
        lead=r"[sr]k_live_",
    ),
    Rule(
        "slack-token",
        "Slack Token",
        r"\b(xox[baprs]-[0-9a-zA-Z]{10,48})\b",
        hints=("xox",),
        lead=r"xox",
    ),
    Rule(
        "jwt-token",
        "JSON Web Token (JWT)",
        r"\b(eyJ[a-zA-Z0-9_-]{10,}\.eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,})\b",
        hints=(".eyJ",),
        lead=r"eyJ",
    ),
    Rule(
        "private-key",
        "Cryptographic Private Key",
        r"-----BEGIN\s+(?:[A-Z0-9_-]+\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(?:[A-Z0-9_-]+\s+)?PRIVATE\s+KEY-----",
        hints=("-----BEGIN",),
    ),
    Rule(
        "database-uri",
        "Database Connection String with Credentials",
        r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis):\/\/[^:\s\/]+:([^@\s\/]+)@[^:\s\/]+",
        group=1,
        ignore_case=True,
        hints=("://",),
        lead=r"(?:postgres|mysql|mongodb|redis)",
    ),
    Rule(
        "generic-api-key-assign",
        "Generic API Key / Secret Assignment",
        r"""(?:api[_-]?key|secret[_-]?token|auth[_-]?token|access[_-]?token|private[_-]?key)\s*[:=]\s*["']([a-zA-Z0-9_\-\.]{20,100})["']""",
        group=1,
        min_entropy=3.8,
        ignore_case=True,
        hints=("key", "token"),
    ),
)


def java_pattern(rule: Rule) -> str:
    """A rule's regex in Java, its lead looked for first."""
    flags = "(?i)" if rule.ignore_case else ""
    lead = f"(?={rule.lead})" if rule.lead else ""
    return flags + lead + java_regex(rule.regex)


_JAVA_SPACE = "".join(f"\\u{ord(c):04X}" for c in WHITE_SPACE)
_JAVA_BOUNDARY = (
    "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)


def java_regex(regex: str, ignore_case: bool = False) -> str:
    """Rule language -> Java: spell out ``\\b`` (ASCII) and ``\\s`` (Unicode)."""
    out, in_class, escaped = [], False, False
    for ch in regex:
        if escaped:
            escaped = False
            if ch == "b" and not in_class:
                out.append(_JAVA_BOUNDARY)
            elif ch == "s":
                out.append(_JAVA_SPACE if in_class else f"[{_JAVA_SPACE}]")
            else:
                out.append("\\" + ch)
        elif ch == "\\":
            escaped = True
        else:
            in_class = ch == "[" or (in_class and ch != "]")
            out.append(ch)
    return ("(?i)" if ignore_case else "") + "".join(out)
