"""Names, patterns, lists and texts that results are compared on.

Everything in this module is data. The values are fixed by the behaviour being matched, so they are
written out plainly and in their natural order; the logic that uses them is in ``operators``.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: file selection -------------------------------------------------------------

CODE_EXTENSIONS = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".c", ".cpp", ".h", ".hpp", ".cs",
    ".rb", ".php", ".swift", ".kt", ".scala", ".sh", ".bash", ".sql", ".yaml", ".yml", ".json",
    ".xml", ".html", ".css", ".scss", ".vue",
)
SKIPPED_PATHS = (
    "node_modules/", "venv/", "env/", "__pycache__/", ".git/", "dist/", "build/", "target/",
    ".idea/", "vendor/", "coverage/", ".next/", "out/",
)
PYTHON_EXTENSIONS = (".py",)
SCRIPT_EXTENSIONS = (".js", ".ts", ".jsx", ".tsx")
SQL_EXTENSIONS = (".sql",)
HASH_COMMENT_EXTENSIONS = (".py", ".sh")

SEVERITIES = ("critical", "high", "medium", "low", "info")
PATTERN_TOOL = "pattern-matcher"
REPORT_TOOLS = ("bandit", "semgrep")


@dataclass(frozen=True)
class Rule:
    """One pattern rule. ``extensions=None`` means every file.

    ``multiline`` rules see the whole text instead of one line at a time and report the unstripped
    line. ``within_line`` says that a multiline pattern can never match across a line break, which
    lets it share the line pass. ``literals``, if given, are lower-case texts of which every match
    holds at least one; they let the scan pass over most lines without running the pattern.
    """

    name: str
    pattern: str
    severity: str
    description: str
    recommendation: str
    extensions: tuple[str, ...] | None = None
    multiline: bool = False
    within_line: bool = False
    literals: tuple[str, ...] = ()

    def __post_init__(self):
        if any(part != part.lower() or not part.isascii() for part in self.literals):
            raise ValueError(f"rule {self.name!r}: literals are compared with lower-cased ASCII text: {self.literals}")


# --- fixed values: pattern rules (matched without regard to case) -------------------------------

RULES = (
    Rule(
        "hardcoded_password",
        r"""(password|passwd|pwd)\s*=\s*["\']([^"\']+)["\']""",
        "high",
        "Hardcoded password detected",
        "Use environment variables or secure secret management",
        literals=("password", "passwd", "pwd"),
    ),
    Rule(
        "hardcoded_api_key",
        r"""(api[_-]?key|apikey|access[_-]?token)\s*=\s*["\']([a-zA-Z0-9_-]{20,})["\']""",
        "critical",
        "Hardcoded API key or token detected",
        "Store secrets in environment variables or secret manager",
        literals=("api", "access"),
    ),
    Rule(
        "sql_injection",
        r"(execute|executemany|cursor\.execute)\s*\([^)]*[+%]\s*\w+",
        "critical",
        "Potential SQL injection vulnerability (string concatenation)",
        "Use parameterized queries or prepared statements",
        (".py", ".java", ".php", ".rb"),
        literals=("execute",),
    ),
    Rule(
        "command_injection",
        r"(os\.system|subprocess\.call|exec|eval|shell_exec)\s*\([^)]*[+%]\s*\w+",
        "critical",
        "Potential command injection vulnerability",
        "Use subprocess with list arguments, avoid shell=True",
        (".py", ".js", ".php", ".rb"),
        literals=("os.system", "subprocess.call", "exec", "eval"),
    ),
    Rule(
        "path_traversal",
        r"open\s*\([^)]*\+\s*\w+|os\.path\.join\s*\([^)]*user",
        "high",
        "Potential path traversal vulnerability",
        "Validate and sanitize file paths, use os.path.normpath()",
        (".py", ".java", ".php"),
        literals=("open", "os.path.join"),
    ),
    Rule(
        "insecure_random",
        r"import\s+random|from\s+random\s+import",
        "medium",
        "Using insecure random for potential security context",
        "Use secrets module for cryptographic operations",
        (".py",),
        literals=("random",),
    ),
    Rule(
        "debug_mode",
        r"DEBUG\s*=\s*True|debug\s*=\s*True|app\.debug\s*=\s*True",
        "medium",
        "Debug mode enabled",
        "Disable debug mode in production",
        (".py", ".js", ".java"),
        literals=("debug",),
    ),
    Rule(
        "unsafe_deserialization",
        r"pickle\.loads|yaml\.load\(|eval\(|exec\(",
        "high",
        "Unsafe deserialization detected",
        "Use safe_load for YAML, avoid pickle with untrusted data",
        (".py",),
        literals=("pickle.loads", "yaml.load(", "eval(", "exec("),
    ),
    Rule(
        "weak_crypto",
        r"md5|MD5|sha1|SHA1|DES|RC4",
        "medium",
        "Weak cryptographic algorithm detected",
        "Use SHA256, SHA384, or SHA512 for hashing",
        literals=("md5", "sha1", "des", "rc4"),
    ),
    Rule(
        "missing_csrf_protection",
        r"@app\.route.*methods.*POST(?!.*csrf)",
        "high",
        "POST endpoint without apparent CSRF protection",
        "Implement CSRF protection for state-changing operations",
        (".py",),
        multiline=True,
        within_line=True,
        literals=("@app.route",),
    ),
)


@dataclass(frozen=True)
class Check:
    """A check that is not a pattern rule: its name, severity and texts."""

    name: str
    severity: str
    description: str
    recommendation: str


# --- fixed values: whole-file security checks ---------------------------------------------------

UNSAFE_PICKLE = Check(
    "unsafe_pickle", "high",
    "Using pickle without safety considerations",
    "Validate pickle source, consider JSON or safer alternatives",
)
MISSING_HTTPS = Check(
    "missing_https", "medium",
    "Flask app without HTTPS configuration",
    "Use SSL/TLS in production",
)
EVAL_USAGE = Check(
    "eval_usage", "high",
    "Use of eval() can lead to code injection",
    "Avoid eval(), use JSON.parse() or safer alternatives",
)
INNER_HTML = Check(
    "innerHTML_xss", "medium",
    "Using innerHTML can lead to XSS vulnerabilities",
    "Use textContent or sanitize HTML input",
)
SELECT_STAR = Check(
    "select_star", "low",
    "SELECT * can expose sensitive data",
    "Explicitly specify columns needed",
)
EVAL_PATTERN = r"\beval\s*\("
INNER_HTML_PATTERN = r"\.innerHTML\s*="
SELECT_STAR_PATTERN = r"SELECT\s+\*"

# --- fixed values: quality checks ({} marks where a value is filled in) --------------------------

CONSOLE_LOG = Check(
    "console_log", "low",
    "Console.log statement found",
    "Remove debug statements before production",
)
VAR_USAGE = Check(
    "var_usage", "low",
    'Using "var" instead of "let" or "const"',
    'Use "let" or "const" for better scoping',
)
LOOSE_EQUALITY = Check(
    "loose_equality", "low",
    "Using loose equality (==) instead of strict (===)",
    "Use === for strict equality checks",
)
LONG_LINE = Check(
    "long_line", "low",
    "Line {} exceeds 120 characters ({})",
    "Break long lines for better readability",
)
TODO_COMMENT = Check(
    "todo_comment", "info",
    "TODO/FIXME comment found",
    "Consider creating a ticket for this work",
)
COMMENT_RATIO = Check(
    "high_comment_ratio", "info",
    "High comment ratio ({})",
    "Excessive comments might indicate complex code that needs refactoring",
)
MAGIC_NUMBER = Check(
    "magic_number", "low",
    "Magic number {} found",
    "Consider using named constants",
)
LONG_FILE = Check(
    "long_file", "medium",
    "File is very long ({} lines)",
    "Consider splitting into multiple modules",
)
HIGH_COMPLEXITY = Check(
    "high_complexity", "medium",
    'Function "{}" has high complexity ({})',
    "Consider breaking down into smaller functions",
)
LONG_FUNCTION = Check(
    "long_function", "low",
    'Function "{}" is {} lines long',
    "Consider splitting into smaller, focused functions",
)
MISSING_DOCSTRING = Check(
    "missing_docstring", "low",
    '{} "{}" missing docstring',
    "Add docstring to document purpose and usage",
)
SYNTAX_ERROR = Check(
    "syntax_error", "critical",
    "Syntax error: {}",
    "Fix syntax error before proceeding",
)

CONSOLE_PATTERN = r"console\.(log|debug|info)"
VAR_PATTERN = r"\bvar\s+\w+"
LOOSE_EQUALITY_PATTERN = r"[^=!<>]={2}[^=]"
TODO_PATTERN = r"(TODO|FIXME|HACK|XXX):"
TODO_LITERALS = ("todo:", "fixme:", "hack:", "xxx:")
NUMBER_PATTERN = r"\b(\d+\.?\d*)\b"
ALLOWED_NUMBERS = ("0", "1", "100", "0.0", "1.0")
SCRIPT_FUNCTION_PATTERNS = (
    r"function\s+\w+",
    r"const\s+\w+\s*=\s*\([^)]*\)\s*=>",
    r"async\s+function",
)

MAX_LINE_LENGTH = 120
MAX_FILE_LINES = 500
MAX_COMMENT_RATIO = 0.3
MAX_COMPLEXITY = 10
MAX_FUNCTION_LINES = 50

# --- fixed values: scanner reports --------------------------------------------------------------

BANDIT_DEFAULTS = {
    "severity": "LOW", "issue": "Unknown", "description": "Security issue detected",
    "confidence": "MEDIUM",
}
BANDIT_RECOMMENDATIONS = {
    "B201": "Avoid using flask app with debug=True in production",
    "B301": "Avoid using pickle; use safer serialization like JSON",
    "B303": "Use hashlib.sha256() instead of MD5 or SHA1",
    "B304": "Use secrets module instead of insecure ciphers",
    "B308": "Use safe_load() instead of load() when parsing YAML",
    "B311": "Use secrets module for cryptographic randomness",
    "B501": "Request with verify=False disables SSL verification",
    "B506": "Use safe YAML loading methods",
    "B601": "Potential shell injection; use subprocess with list args",
    "B602": "Avoid shell=True in subprocess calls",
    "B608": "Potential SQL injection; use parameterized queries",
}
BANDIT_RECOMMENDATION = "Review security best practices for this pattern"
SEMGREP_DEFAULTS = {
    "severity": "INFO", "issue": "Unknown", "description": "Security pattern detected",
}
SEMGREP_RECOMMENDATION = "Follow security best practices to address this finding"
REFERENCE_TEXT = "See: "
CWE_TEXT = "Related to CWE-"
OWASP_TEXT = "OWASP: "

# --- fixed values: list lengths and verdict texts -----------------------------------------------

LISTED_FINDINGS = 10
PROMPT_FILES = 10
PROMPT_FINDINGS = 5
MAX_QUALITY_ISSUES = 10

REQUEST_CHANGES = "Request Changes"
APPROVE = "Approve with Comments"
VERDICTS = {
    "critical": ("❌", REQUEST_CHANGES, "Critical security issues must be addressed"),
    "high": ("⚠️", REQUEST_CHANGES, "High priority security issues found"),
    "quality": ("⚠️", REQUEST_CHANGES, "Multiple quality issues should be addressed"),
    "none": ("✅", APPROVE, "Minor issues can be addressed in follow-up"),
}

# --- fixed values: rendered texts ({name} marks where a column is filled in) ----------------------

SUMMARY_TEXT = """# Code Review Summary

## Security Analysis
- **Critical**: {critical} issues
- **High**: {high} issues
- **Medium**: {medium} issues
- **Low**: {low} issues

## Code Quality
- **Total Issues**: {quality_issues}
- **Functions Analyzed**: {functions}
- **Lines of Code**: {lines_of_code}

## Recommendation
{mark} **{verdict}** - {reason}
"""

REVIEW_PROMPT = """You are a senior software engineer performing a code review.

Pull Request: {title}
Description: {description}
Author: {author}
Files Changed: {files_changed}
Total Changes: +{total_additions} -{total_deletions}

Files Modified:
{files_json}

Automated Analysis Found:
- {critical} Critical Security Issues
- {high} High Security Issues
- {quality_medium_high} Medium/High Quality Issues

Critical Security Issues:
{critical_json}

High Priority Quality Issues:
{quality_json}

Please provide a comprehensive code review with:

1. **Overall Assessment** (2-3 sentences)
2. **Security Concerns** (prioritized list with severity)
3. **Code Quality Feedback** (maintainability, readability, best practices)
4. **Architecture & Design** (if applicable)
5. **Testing Recommendations** (what should be tested)
6. **Approval Recommendation** (Approve / Request Changes / Needs Discussion)

Be specific and actionable. Reference actual issues found. Consider the context and size of the change.
Format your response in clear markdown sections.
"""

FILE_PROMPT = """You are an expert code reviewer. Review the following code file and provide feedback.

File: {filename}
{context_line}

Code:
```
{content}
```

Provide a structured review covering:
1. **Security Concerns**: Any potential security vulnerabilities
2. **Code Quality**: Readability, maintainability, and best practices
3. **Performance**: Potential performance issues or optimizations
4. **Best Practices**: Language-specific conventions and patterns
5. **Positive Aspects**: What's done well

Focus on actionable, specific feedback with examples where helpful.
"""

SNIPPET_PROMPT = """You are an expert code reviewer. A {issue_type} issue was detected in this code:

```
{code}
```

Provide:
1. A clear explanation of why this is an issue
2. Specific code example showing how to fix it
3. Best practices to prevent similar issues

Be concise but specific.
"""
