"""Rule sets, per language: where units, calls and decisions are in a text.

Each is data, so another language or another line-structured text is another entry. The patterns work on
single lines and have no look-around, so they run unchanged in Spark and DuckDB.
"""

from __future__ import annotations

from dataclasses import dataclass

# Rule sets by name, and the languages each one serves.
FAMILIES = {"java": ("java",), "python": ("python",), "go": ("go",), "typescript": ("typescript", "javascript")}

# Lines that open a class-like block; group 1 is its name.
CLASS_LINE = {
    "java": r"^\s*(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(?:class|interface|enum|record)\s+(\w+)",
    "python": r"^\s*class\s+(\w+)",
    "go": r"^type\s+(\w+)\s+(?:struct|interface)\b",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+(\w+)",
}

# What stands between the parentheses of a parameter list, with one level of parentheses inside.
_PARAMS = r"([^()]*(?:\([^()]*\)[^()]*)*)"

# Lines that open a unit; group 1 is its name, group 2 its parameters.
UNIT_LINE = {
    "java": r"^\s+(?:@\w+(?:\([^()]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)*"
    r"(?:[\w<>\[\],.? ]*[\w>\]]\s+)?(\w+)\s*\(" + _PARAMS + r"\)\s*(?:throws\s+[\w.,\s]+)?(?:\{.*|;\s*)$",
    "python": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(" + _PARAMS + r"\)\s*(?:->[^:]*)?:",
    "go": r"^func\s+(?:\([^()]*\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?\(" + _PARAMS + r"\)[^(){]*(?:\([^()]*\)[^(){]*)*\{",
    "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:(?:public|protected|private|static|async|function)\s+)*(\w+)\s*(?:<[^()]*>\s*)?\(" + _PARAMS + r"\)[^();]*\{",
}
# A Java method without a body has a type before its name; a call has none.
TYPED = r"^\s+[^(]*[\w>\]]\s+\w+\s*\("
# Lines that give a name a function as its value.
VALUE_LINE = {
    "typescript": r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]*)?=\s*(?:async\s+)?(?:function\s*\w*\s*)?(?:\(" + _PARAMS + r"\)|\w+)\s*(?::[^=>]*)?(?:=>|\{)",
}
# What a line must hold for the patterns above to match: of each group one. Looked for first, as it costs less.
_CLASS_WORDS, _PARENTHESIS = (("class", "interface", "enum", "record"),), ("(",)
NEEDED = {
    "java": {"class": _CLASS_WORDS, "unit": (_PARENTHESIS, ("{", ";"))},
    "python": {"class": (("class",),), "unit": (("def",), _PARENTHESIS)},
    "go": {"class": (("type",), ("struct", "interface")), "unit": (("func",), _PARENTHESIS, ("{",))},
    "typescript": {"class": (("class", "interface"),), "unit": (_PARENTHESIS, ("{",)), "value": (("const", "let", "var"), ("=",))},
}


def indent_once(pattern: str) -> str:
    """``pattern`` for Spark only: it never gives back some of the indent, which no later part needs, to try the rest of the line anew."""
    for start in (r"^\s+", r"^\s*"):
        if pattern.startswith(start):
            return f"{start}+{pattern[len(start):]}"
    return pattern


# Field declarations; group 1 is the list of names with their values.
FIELD_LINE = (
    r"^\s+(?:@\w+(?:\([^()]*\))?\s+)*(?:(?:public|protected|private|static|final|volatile|transient)\s+)*"
    r"[\w.]+(?:<[^=;()]*>)?(?:\[\])*\s+(\w+(?:\[\])*\s*(?:;|,.*;|=.*))\s*(?://.*)?$"
)
# Code on the header line itself.
_AFTER_BRACE = r"\)[^()]*?\{(.*)$"
BODY_ON_HEADER = {"java": _AFTER_BRACE, "go": _AFTER_BRACE, "python": r"\)\s*(?:->[^:]*)?:(.*)$", "typescript": r"(?:\)[^()]*?\{|=>)(.*)$"}
GO_RECEIVER = r"^func\s+\(\s*\w*\s*\*?(\w+)[^)]*\)"

# Names a unit line may show that are statements.
STATEMENTS = ("if", "for", "while", "switch", "catch", "synchronized", "return", "new", "else", "try", "do", "function")
# Lines that start like a unit or a field but are statements.
STATEMENT_START = r"^\s*(?:return|throw|new|else|assert|yield|await|case|package|import)\s+\S"
# Words before a parenthesis that are not calls in Go.
NOT_CALLED = ("if", "for", "switch", "return", "func", "go", "defer", "range", "select", "case", "interface", "chan", "map", "struct")


@dataclass(frozen=True)
class Decision:
    """A kind of decision point: group 1 of ``pattern`` is the text that counts."""

    kind: str
    pattern: str
    weight: int = 0  # priority per point of complexity
    fixed: int = 0  # priority regardless of it
    least: int = 0  # complexity is raised to this
    hint: str = "complete the condition"
    default: bool = True


# Weights, hints and keywords per language.
_IF_BRACE = r"\bif\s*(\(.*\))\s*\{"
DECISIONS = {
    "java": (
        Decision("condition", _IF_BRACE, weight=10),
        Decision("switch", r"\bswitch\s*(\(.*\))\s*\{", weight=9, least=1, hint="complete the switch expression"),
        Decision("condition", r"(?:=|\breturn)\s+([^;?{}=]+) \? ", weight=8, least=1),
        Decision("return", r"(\breturn\s[^\n]*;)", weight=8, hint="complete the return statement", default=False),
        Decision("error", r"(\bthrow\s[^\n]*;)", fixed=7, hint="add error handling"),
    ),
    "go": (
        Decision("condition", r"\bif\s+([^{;]+)\s\{", weight=10),
        Decision("switch", r"\bswitch\s+([^{;]+)\s\{", weight=9, least=1, hint="complete the switch expression"),
        Decision("return", r"(\breturn\s[^\n]*)", weight=8, hint="complete the return statement", default=False),
    ),
    "python": (
        Decision("condition", r"\b(?:el)?if\s+([^\n]+):", weight=10),
        Decision("condition", r"(?:=|\breturn)\s+[^\n]+\sif\s([^\n]+)\selse\s", weight=8),
        Decision("error", r"(\braise\s[^\n]*)", fixed=7, hint="add error handling"),
    ),
    "typescript": (
        Decision("condition", r"\b(?:if|while)\s*(\(.*\))\s*\{", weight=10),
        Decision("switch", r"\bswitch\s*(\(.*\))\s*\{", weight=8, hint="complete switch selector"),
        Decision("condition", r"(?:=|\breturn)\s+([^;?{}=]+) \? ", weight=10),
        Decision("return", r"(\breturn\s[^\n]*;)", fixed=6, hint="return the correct value", default=False),
        Decision("error", r"(\bthrow\s[^\n]*;)", fixed=7, hint="add error handling"),
    ),
}
# Returns that are too plain to be a decision.
BARE_RETURN = {"java": r"return;|return null;", "go": r"^return(\s+nil)?\s*$", "python": r"^return$", "typescript": r"^return;$"}
VALIDATION_WORDS = {
    "java": ("null", "isEmpty", "isBlank", "length", "valid", "check", "verify", "assert"),
    "go": ("nil", "err", "empty", "valid", "check", "null", "isEmpty", "isBlank", "length", "verify", "assert"),
    "python": ("none", "empty", "len(", "validate", "check", "assert", "isinstance", "not "),
    "typescript": ("null", "undefined", "length", "empty", "validate", "check", "instanceof"),
}
VALIDATION_HINT = "add validation check"
GO_ERROR_PRIORITY, GO_ERROR_HINT = 15, "add error check"

# What a masked span becomes; ``{}`` is the marker.
BRACE_MARKER, HASH_MARKER = '/* [MASK:session={} id={} hint="{}"] */', '# [MASK:session={} id={} hint="{}"]'
PLACEHOLDERS = {
    "java": {"condition": "(true {})", "validation": "(true {})", "return": "return null; {}", "error": "throw new RuntimeException(); {}"},
    "go": {"condition": "(true {})", "validation": "(true {})", "return": "return nil {}", "error": "{}"},
    "python": {"condition": "True", "validation": "True", "return": "True", "error": 'raise Exception("TODO")'},
    "typescript": {"condition": "true {}", "validation": "true {}", "return": "return null; {}", "error": 'throw new Error("TODO"); {}'},
}

# Markers left in a text; groups are session, id and hint.
MARKERS = (
    r'/\* \[MASK:session=([^\s]+)\s+id=([^\s]+)\s+hint="([^"]*)"\] \*/',
    r'# \[MASK:session=([^\s]+)\s+id=([^\s]+)\s+hint="([^"]*)"\]',
)
MASKS_PER_UNIT = 3

# Call forms in a line: a method reference, a constructor, or a call with an optional receiver.
CALL = r"(\w+)::(\w+)|\bnew\s+(\w+)|((?:\w+\.)*)(\w+)\s*\("
# The same for Spark only: words are never given back, and tried from their first letter alone. That finds the same.
FAST_CALL = r"(?<!\w)(?:(\w++)::(\w+)|\bnew\s+(\w+)|((?:\w++\.)*+)(\w++)\s*+\()"
# Declarations that give a name a type: ``Type name =``, ``Type name;``; groups are type and name.
DECLARATION = r"\b([A-Z]\w*)(?:<[^;=()]*>)?\s+(\w+)\s*(?:=[^=]|;)"
