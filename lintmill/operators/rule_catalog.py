"""The line rules as data.

``pattern`` is searched anywhere in a line.  ``needles`` are literals one of
which every match contains: a plain byte search for them spares most lines the
regular expression.
"""

from __future__ import annotations

from typing import NamedTuple


class LineRule(NamedTuple):
    rule_id: str
    pattern: str
    needles: tuple[str, ...]
    category: str
    severity: str
    confidence: float
    title: str
    explanation: str
    suggestion: str


# ---- fixed values: identifiers, patterns, classes and thresholds ------------

MAX_LINE_LENGTH = 120
MAX_FILE_LINES = 500
MAX_FUNCTION_LINES = 50
MAX_COMPLEXITY = 10
BLOCK_LINES = 4

LONG_LINE = LineRule(
    "long-line", "", (), "code_smell", "low", 0.9,
    "Overlong line",
    "The line is longer than the recommended number of characters.",
    "Wrap the line.",
)

COMMON_RULES = [
    LineRule(
        "todo-comment", r"\b(TODO|FIXME|HACK|XXX)\b", ("TODO", "FIXME", "HACK", "XXX"),
        "code_smell", "info", 0.95,
        "Open TODO marker",
        "Work was left unfinished here.",
        "Finish the work or file a ticket for it.",
    ),
    LineRule(
        "hardcoded-api-key",
        r"""(?i)(api[_-]?key|secret|password|token)\s*[:=]\s*['"][^'"]{8,}['"]""", ("'", '"'),
        "security", "high", 0.85,
        "Hardcoded secret suspected",
        "A credential seems to be written into the source, where every reader sees it.",
        "Read the secret from the environment or a vault.",
    ),
    LineRule(
        "aws-access-key", r"AKIA[0-9A-Z]{16}", ("AKIA",),
        "security", "critical", 0.85,
        "AWS access key suspected",
        "A credential seems to be written into the source, where every reader sees it.",
        "Read the secret from the environment or a vault.",
    ),
]

SCRIPT_RULES = [
    LineRule(
        "js-eval", r"\beval\s*\(", ("eval",), "security", "critical", 0.95,
        "eval() call",
        "Text is run as program code.",
        "Parse the data instead, for instance with JSON.parse().",
    ),
    LineRule(
        "js-inner-html", r"\.innerHTML\s*=", (".innerHTML",), "security", "high", 0.85,
        "innerHTML written",
        "Unescaped markup opens the page to script injection.",
        "Set textContent, or sanitize the markup.",
    ),
    LineRule(
        "js-document-write", r"\bdocument\.write\s*\(", ("document.write",),
        "security", "medium", 0.8,
        "document.write() call",
        "It blocks rendering and may inject script.",
        "Create and append DOM nodes.",
    ),
    LineRule(
        "js-console-log", r"\bconsole\.(log|debug|info)\s*\(", ("console.",),
        "code_smell", "info", 0.7,
        "Console output",
        "It looks like a debugging aid that was left in.",
        "Delete it or use a logger.",
    ),
    LineRule(
        "js-var-keyword", r"\bvar\s+\w+", ("var",), "code_smell", "low", 0.75,
        "var declaration",
        "A var is visible in the whole function, which hides mistakes.",
        "Declare with const or let.",
    ),
    LineRule(
        "js-any-type", r":\s*any\b", ("any",), "code_smell", "low", 0.8,
        "any type annotation",
        "The value escapes type checking.",
        "Name the type, or take unknown and narrow it.",
    ),
    LineRule(
        "js-empty-catch", r"catch\s*\([^)]*\)\s*\{\s*\}", ("catch",), "bug", "medium", 0.85,
        "Catch without body",
        "Errors vanish unnoticed.",
        "Treat the error or throw it on.",
    ),
]

JAVA_RULES = [
    LineRule(
        "java-system-out", r"\bSystem\.(out|err)\.print", ("System.",), "code_smell", "low", 0.85,
        "Printing to the standard streams",
        "Server code should log through a framework.",
        "Call a logger.",
    ),
    LineRule(
        "java-empty-catch", r"catch\s*\([^)]+\)\s*\{\s*\}", ("catch",), "bug", "medium", 0.85,
        "Catch without body",
        "Exceptions vanish unnoticed.",
        "Treat or log the exception.",
    ),
    LineRule(
        "java-thread-stop", r"\.stop\s*\(", (".stop",), "bug", "high", 0.7,
        "stop() on a thread",
        "Stopping a thread by force is deprecated and leaves broken state.",
        "Interrupt it and let it end by itself.",
    ),
]

GO_RULES = [
    LineRule(
        "go-fmt-println", r"\bfmt\.Println\s*\(", ("fmt.Println",), "code_smell", "info", 0.7,
        "fmt.Println output",
        "It looks like a debugging aid that was left in.",
        "Log in a structured way.",
    ),
    LineRule(
        "go-panic", r"\bpanic\s*\(", ("panic",), "bug", "medium", 0.75,
        "panic() call",
        "The goroutine dies unless somebody recovers.",
        "Return an error.",
    ),
    LineRule(
        "go-empty-err-check", r",\s*_\s*:=", (":=",), "code_smell", "low", 0.65,
        "Result dropped with the blank identifier",
        "The dropped value may be an error.",
        "Look at the returned error.",
    ),
]

RUST_RULES = [
    LineRule(
        "rust-unwrap", r"\.unwrap\s*\(", (".unwrap",), "bug", "medium", 0.8,
        "unwrap() call",
        "It panics when there is no value.",
        "Match on the value.",
    ),
    LineRule(
        "rust-expect", r"\.expect\s*\(", (".expect",), "code_smell", "low", 0.7,
        "expect() call",
        "It panics, if with a message.",
        "Hand the error on with the ? operator.",
    ),
    LineRule(
        "rust-unsafe", r"\bunsafe\s*\{", ("unsafe",), "security", "high", 0.9,
        "unsafe block",
        "The compiler's guarantees do not hold inside.",
        "Keep it small and write down why it is sound.",
    ),
]

CSHARP_RULES = [
    LineRule(
        "csharp-empty-catch", r"catch\s*\([^)]*\)\s*\{\s*\}", ("catch",), "bug", "medium", 0.85,
        "Catch without body",
        "Exceptions vanish unnoticed.",
        "Treat or log the exception.",
    ),
    LineRule(
        "csharp-console-write", r"\bConsole\.(WriteLine|Write)\s*\(", ("Console.",),
        "code_smell", "info", 0.75,
        "Console output",
        "It looks like a debugging aid that was left in.",
        "Call ILogger.",
    ),
]

CPP_RULES = [
    LineRule(
        "cpp-using-namespace-std", r"using\s+namespace\s+std\s*;", ("namespace",),
        "code_smell", "low", 0.9,
        "using namespace std",
        "All names of std enter the scope and may clash.",
        "Write std:: or import single names.",
    ),
    LineRule(
        "cpp-malloc-free", r"\b(malloc|free)\s*\(", ("malloc", "free"),
        "code_smell", "medium", 0.85,
        "Memory managed by hand",
        "Hand-written malloc and free are easily mismatched.",
        "Use containers and smart pointers.",
    ),
    LineRule(
        "cpp-strcpy", r"\b(strcpy|strcat|sprintf|gets)\s*\(",
        ("strcpy", "strcat", "sprintf", "gets"),
        "security", "high", 0.9,
        "Unbounded C string function",
        "The function writes without knowing the size of its buffer.",
        "Use a function that takes the size, or std::string.",
    ),
]

LANGUAGE_RULES = {
    "python": [],
    "javascript": SCRIPT_RULES,
    "typescript": SCRIPT_RULES,
    "java": JAVA_RULES,
    "go": GO_RULES,
    "rust": RUST_RULES,
    "csharp": CSHARP_RULES,
    "cpp": CPP_RULES,
}

FUNCTION_START = (
    r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"
    r"|(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{)"
)
