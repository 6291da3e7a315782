"""The regular expressions that define a failure signature.

Everything in this module is data. The patterns use Java syntax and are the
definition of what two runs of one failure have in common, so they must not be
reordered or tuned.
"""

ESC = "\\x1b"

# ---- fixed values: rewrites of one raw log line, in order -------------------
REWRITES = [
    # control sequences
    (r"\r", ""),
    (ESC + r"\][^\x07\x1b]{0,512}(?:\x07|\x1b\\)", ""),
    (ESC + r"\[[0-9;?]{0,24}[ -/]{0,4}[@-~]", ""),
    (ESC, ""),
    # clocks and dates
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"\d{4}-\d{2}-\d{2}", "<TS>"),
    (r"\b\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,3})?\b", "<TS>"),
    (r"^(?:\s*(?:\[\s*)?<TS>(?:\s*\])?\s*){1,4}", ""),
    # runner markers
    (r"(?i)^\s*##\[error\]\s*", "[ERROR] "),
    (r"(?i)^\s*##\[(?:warning|notice|group|endgroup|debug|command|section)\]\s*", ""),
    (r"^(?:\s*(?:\[\s*)?<TS>(?:\s*\])?\s*){1,4}", ""),
    # absolute paths of three or more parts keep the last two
    (r"(?<![\w.$-])(?:/[\w.+@%-]{1,64}){1,30}/([\w.+@%-]{1,64}/[\w.+@%-]{1,64})", "$1"),
    (r"\b[A-Za-z]:(?:\\[\w.+@%-]{1,64}){0,30}\\([\w.+@%-]{1,64})\\([\w.+@%-]{1,64})", "$1/$2"),
    # identifiers
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b0[xX][0-9a-fA-F]{1,16}\b", "<ADDR>"),
    # source positions
    (r":\[\d{1,7},\d{1,7}\]", ":[<L>,<C>]"),
    (r"\((\d{1,7}),(\d{1,7})\):", "(<L>,<C>):"),
    (r"(\.[A-Za-z]{1,6}):\d{1,7}:\d{1,7}", "$1:<L>:<C>"),
    (r"(\.[A-Za-z]{1,6}):\d{1,7}", "$1:<L>"),
    (r"(?i)\bline \d{1,7}\b", "line <L>"),
    # scalars
    (r"\b\d+(?:[.,]\d+)?\s?(?:[KMGT]i?B|bytes)\b", "<SIZE>"),
    (
        r"\b\d+(?:[.,]\d+)?\s?(?:ms|us|ns|s|m|h|sec|secs|second|seconds|min|mins|minute|minutes"
        r"|hr|hrs|hour|hours)\b",
        "<DUR>",
    ),
    (
        r"\b(localhost|\d{1,3}(?:\.\d{1,3}){3}|[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,6})"
        r":\d{2,5}\b",
        "$1:<PORT>",
    ),
    (r"\b(pid|PID|Pid)\s*[:=]?\s*\d{1,10}\b", "pid <PID>"),
    (r"(?:^|\s)#\d{1,9}\b", " #<N>"),
    (r"\b\d{4,}\b", "<N>"),
    (r"\b(?![a-f]{7,64}\b)[0-9a-f]{7,64}\b", "<HEX>"),
    (r"[ \t]{2,}", " "),
]

# One entry per rewrite: texts of which a line must hold at least one for the pattern to
# match anything. They only save time; the patterns above decide.
DIGITS = list("0123456789")
REWRITE_NEEDS = [
    ["\r"], ["\x1b"], ["\x1b"], ["\x1b"],
    ["-"], ["-"], [":"], ["<TS>"],
    ["##["], ["##["], ["<TS>"],
    ["/"], [":\\"],
    ["-"], ["0x", "0X"],
    [":["], ["):"], [":"], [":"],
    ["e ", "E "], ["B", "bytes"], DIGITS, [":"], ["pid", "PID", "Pid"], ["#"], DIGITS, DIGITS,
    ["  ", "\t"],
]
FIRST_SCALAR, AFTER_SCALARS = 19, 27  # the rewrites of this range need a digit

# ---- fixed values: words that make a raw line worth classifying, in any case --
TRIGGER_WORDS = [
    "error", "fail", "exception", "kill", "denied", "refus", "unable", "cannot", "could not",
    "missing", "timeout", "timed out", "not found", "no matching", "unauthori", "forbidden",
    "traceback", "fatal", "credential", "memory", "heap", "exit code", "cancel", "exceed",
    "deadline", "reformat", "problems", "violation", "err!", "etimedout", "enotfound",
    "eai_again", "eacces", "eperm", "econnreset", "ehostunreach", "enetunreach",
    "✕", "✖", "✗", "×", "●", "expect(", "assert",
]

# ---- fixed values: (category, priority, confidence, alternatives) -----------
# lowest priority wins; at one priority the later line wins
RULES = [
    ("oom", 10, 1.0, [
        r"java\.lang\.OutOfMemoryError",
        r"(?i:JavaScript heap out of memory)",
        r"(?i:FATAL ERROR: .{0,80}(?:heap|memory))",
    ]),
    ("oom", 11, 0.95, [
        r"\bOOMKilled\b",
        r"(?i:Out of memory: Kill(?:ed)? process)",
        r"(?i:\bmemory cgroup out of memory\b)",
        r"(?i:Container .{0,60}(?:was )?OOM)",
    ]),
    ("oom", 12, 0.9, [
        r"(?i:exit(?:ed)? (?:with )?(?:code|status)[: ]{1,3}137\b|exit code 137\b|code=137\b|status 137\b)",
    ]),
    ("oom", 13, 0.75, [r"(?:^|:\s)(?:<N> )?Killed\b", r"(?i:\bsignal: killed\b)"]),
    ("infra_timeout", 15, 1.0, [
        r"(?i:Build timed out \(after )",
        r"(?i:has exceeded the maximum execution time)",
        r"^Cannot contact [\w.-]{1,64}:",
    ]),
    ("infra_timeout", 15, 0.95, [
        r"(?i:lost communication with the server)",
        r"hudson\.remoting\.(?:ChannelClosedException|RequestAbortedException)",
    ]),
    ("infra_timeout", 16, 0.9, [
        r"(?i:The runner has received a shutdown signal)",
        r"(?i:The operation was canceled)",
        r"\bcontext deadline exceeded\b",
        r"(?i:\bexecutor .{0,40}\bwas removed\b)",
    ]),
    ("infra_timeout", 17, 0.85, [
        r"(?i:timeout: sending signal \w{1,10} to command)",
        r"(?i:exit(?:ed)? (?:with )?(?:code|status)[: ]{1,3}124\b|exit code 124\b)",
    ]),
    ("infra_timeout", 17, 0.8, [
        r"^(?:\[ERROR\] )?FATAL: command execution failed",
        r"(?i:Aborted by .{0,40}Timeout)",
    ]),
    ("test_failure", 20, 1.0, [
        r"^●\s+(?!Console)\S",
        r"^[✕✗×]\s+\S",
        r"^FAILED\s+\S{1,200}::\S",
        r"<<< (?:FAILURE|ERROR)!",
    ]),
    ("test_failure", 21, 0.95, [
        r"^E\s+\w{0,80}(?:Error|Exception|assert)",
        r"^(?:expect\(|AssertionError|assert\b|Expected:|AssertionFailedError)",
        r"Timeout - Async callback was not invoked",
    ]),
    ("test_failure", 22, 0.9, [
        r"^FAIL\s+\S{1,200}", r"^\[ERROR\] Failures:", r"^\[ERROR\] Errors:",
    ]),
    ("test_failure", 25, 0.85, [
        r"^Tests?:\s{0,4}\d{1,6} failed",
        r"Tests run: \d{1,6}, Failures: (?!0\b)\d{1,6}",
        r"Tests run: \d{1,6}, Failures: \d{1,6}, Errors: (?!0\b)\d{1,6}",
        r"^=+ \d{1,6} failed",
    ]),
    ("test_failure", 25, 0.8, [
        r"\b\d{1,6} failed, \d{1,6} passed\b", r"(?i:There are test failures)",
    ]),
    ("test_failure", 26, 0.8, [r"^Test Suites?:\s{0,4}\d{1,6} failed"]),
    ("compile_error", 30, 1.0, [
        r"\berror TS\d{4,5}\b",
        r"\berror: cannot find symbol\b",
        r"^\[ERROR\] COMPILATION ERROR",
        r"(?i:\bCompilation failed\b)",
    ]),
    ("compile_error", 31, 0.95, [
        r"^\[ERROR\] \S{1,200}\.(?:java|kt|scala|groovy):\[<L>,<C>\]",
        r"\.java:<L>: error:",
        r"^e: \S{1,200}\.kts?:",
        r"^error\[E\d{3,4}\]:",
    ]),
    ("compile_error", 32, 0.9, [
        r"^SyntaxError:",
        r"\bTS\d{4,5}: ",
        r"Execution failed for task '\S{0,80}[Cc]ompile\w{0,40}'",
    ]),
    ("compile_error", 33, 0.85, [r"^> Task \S{1,80} FAILED$"]),
    ("dependency_error", 40, 1.0, [
        r"npm ERR! code E(?:404|RESOLVE|INVALIDTAGNAME|NOVERSIONS)",
        r"npm ERR! (?:notarget|404 Not Found - GET)",
        r"Could not resolve dependencies for project",
        r"Could not (?:find|resolve) artifact\b",
        r"Could not find a version that satisfies the requirement",
        r"No matching distribution found for",
    ]),
    ("dependency_error", 41, 0.95, [
        r"Could not resolve all (?:files|dependencies|artifacts) for configuration",
        r"^ERESOLVE\b",
        r"(?i:ResolutionImpossible|version solving failed)",
        r"(?i:peer dep missing|conflicting peer dependency)",
    ]),
    ("dependency_error", 42, 0.85, [
        r"Cannot find module '\S{1,120}'",
        r"ModuleNotFoundError: No module named",
        r"^\[ERROR\] Failed to execute goal \S{0,120}dependency",
    ]),
    ("lint_error", 50, 0.95, [
        r"^[✖✗×]\s+\d{1,6} problems? \(\d{1,6} error",
        r"\[Checkstyle\]",
        r"(?i:Checkstyle rule violations were found)",
        r"\bESLint found \d{1,6} error",
    ]),
    ("lint_error", 51, 0.9, [
        r"^\d{1,6}:\d{1,6}\s+error\s+\S", r":<L>:<C>: [EWF]\d{2,3} \S",
    ]),
    ("lint_error", 52, 0.85, [
        r"(?i:would reformat |Prettier check failed)",
        r"(?i:Execution failed for task '\S{0,80}(?:checkstyle|spotless|ktlint)\w{0,40}')",
    ]),
    ("permission_error", 60, 1.0, [
        r"\bEACCES\b|\bEPERM\b",
        r"\b(?:403 Forbidden|401 Unauthorized)\b",
        r"denied: (?:permission_denied|requested access to the resource is denied)",
        r"Permission (?:to \S{1,120} )?denied",
    ]),
    ("permission_error", 61, 0.95, [
        r"(?i:Authentication failed|authentication required|invalid credentials)",
        r"Bad credentials|Resource not accessible by integration",
        r"\bstatus code 40[13]\b",
    ]),
    ("permission_error", 62, 0.9, [
        r"(?i:not authorized to perform: \S)", r"^sudo: .{0,80}password is required",
    ]),
    ("network_error", 70, 1.0, [
        r"\bECONNREFUSED\b|\bECONNRESET\b|\bEHOSTUNREACH\b|\bENETUNREACH\b",
        r"\bENOTFOUND\b|\bEAI_AGAIN\b",
    ]),
    ("network_error", 70, 0.95, [r"\bETIMEDOUT\b"]),
    ("network_error", 71, 0.9, [
        r"Temporary failure in name resolution|Name or service not known",
        r"(?i:Connection (?:refused|reset by peer|timed out))",
        r"(?:curl|wget): \(\d{1,3}\) (?:Could not resolve|Failed to connect|Connection timed out"
        r"|Operation timed out)",
    ]),
    ("network_error", 72, 0.85, [
        r"CERTIFICATE_VERIFY_FAILED|certificate verify failed|SSLError",
        r"Read timed out|ReadTimeoutError|ConnectTimeoutError",
    ]),
    ("unknown", 90, 0.45, [r"^\[ERROR\] Failed to execute goal \S"]),
    ("unknown", 91, 0.4, [r"^\[ERROR\] \S", r"^(?:ERROR|FATAL|Error):\s+\S"]),
    ("unknown", 92, 0.35, [
        r"Process completed with exit code (?!0\b)\d{1,3}",
        r"\bBUILD FAILURE\b|\bBUILD FAILED\b|FAILURE: Build failed",
    ]),
]

# One entry per rule and pattern: texts of which a line must hold at least one, at its
# start when ``^`` is in front, for the pattern to match. A text with a capital is looked
# for as it is, another one in the lower-cased line. They only save time.
NEEDED = [
    [["java.lang.OutOfMemoryError"], ["javascript heap out of memory"], ["fatal error: "]],
    [["OOMKilled"], ["out of memory: kill"], ["memory cgroup out of memory"], ["oom"]],
    [["137"]],
    [["Killed"], ["signal: killed"]],
    [["build timed out (after "], ["has exceeded the maximum execution time"], ["^Cannot contact "]],
    [["lost communication with the server"], ["hudson.remoting."]],
    [["the runner has received a shutdown signal"], ["the operation was canceled"], ["context deadline exceeded"], ["was removed"]],
    [["timeout: sending signal "], ["124"]],
    [["FATAL: command execution failed"], ["aborted by "]],
    [["^●"], ["^✕", "^✗", "^×"], ["^FAILED"], ["<<< "]],
    [["^E"], ["^expect(", "^AssertionError", "^assert", "^Expected:", "^AssertionFailedError"], ["Timeout - Async callback"]],
    [["^FAIL"], ["^[ERROR] Failures:"], ["^[ERROR] Errors:"]],
    [["^Test"], ["Tests run: "], ["Tests run: "], ["^="]],
    [[" failed, "], ["there are test failures"]],
    [["^Test Suite"]],
    [["error TS"], ["error: cannot find symbol"], ["^[ERROR] COMPILATION ERROR"], ["compilation failed"]],
    [[":[<L>,<C>]"], [".java:<L>: error:"], ["^e: "], ["^error[E"]],
    [["^SyntaxError:"], ["TS"], ["Execution failed for task '"]],
    [["^> Task "]],
    [
        ["npm ERR! code E"], ["npm ERR! "], ["Could not resolve dependencies for project"], ["Could not "],
        ["Could not find a version that satisfies"], ["No matching distribution found for"],
    ],
    [
        ["Could not resolve all "], ["^ERESOLVE"], ["resolutionimpossible", "version solving failed"],
        ["peer dep missing", "conflicting peer dependency"],
    ],
    [["Cannot find module '"], ["ModuleNotFoundError: No module named"], ["^[ERROR] Failed to execute goal "]],
    [["problem"], ["[Checkstyle]"], ["checkstyle rule violations were found"], ["ESLint found "]],
    [["error"], [":<L>:<C>: "]],
    [["would reformat ", "prettier check failed"], ["execution failed for task '"]],
    [["EACCES", "EPERM"], ["403 Forbidden", "401 Unauthorized"], ["denied: "], ["Permission "]],
    [
        ["authentication failed", "authentication required", "invalid credentials"],
        ["Bad credentials", "Resource not accessible by integration"], ["status code 40"],
    ],
    [["not authorized to perform: "], ["^sudo: "]],
    [["ECONNREFUSED", "ECONNRESET", "EHOSTUNREACH", "ENETUNREACH"], ["ENOTFOUND", "EAI_AGAIN"]],
    [["ETIMEDOUT"]],
    [
        ["Temporary failure in name resolution", "Name or service not known"], ["connection "],
        ["curl: (", "wget: ("],
    ],
    [
        ["CERTIFICATE_VERIFY_FAILED", "certificate verify failed", "SSLError"],
        ["Read timed out", "ReadTimeoutError", "ConnectTimeoutError"],
    ],
    [["^[ERROR] Failed to execute goal "]],
    [["^[ERROR] "], ["^ERROR:", "^FATAL:", "^Error:"]],
    [["Process completed with exit code "], ["BUILD FAILURE", "BUILD FAILED", "FAILURE: Build failed"]],
]

# ---- fixed values: normalised lines that carry no identity ------------------
NOISE = [
    r"^[-=_*~#.\s]{3,}$",
    r"^\[INFO\]\s*[-=]{3,}",
    r"^>?\s{0,4}\d{1,6} \|",
    r"^\|?\s{0,8}\^+$",
    r"^(?:Downloading|Downloaded|Progress|Collecting|Requirement already satisfied)\b",
]

# what a line of noise can begin with; normalised lines begin with no blank
NOISE_STARTS = [*"-=_*~#.[>|^0123456789DPCR"]

# ---- fixed values: where a file hint is read from ---------------------------
SOURCE_FILE = (
    r"(?:^|[\s'\"(\[<@])((?:[\w.@-]{1,64}/){0,8}[\w.@-]{1,64}\."
    r"(?:tsx?|jsx?|mjs|cjs|java|kt|kts|py|go|rb|scala|cs|php|rs|c|cc|cpp|h|hpp|swift|m|vue|svelte))\b"
)
SOURCE_NEEDS = [
    ".ts", ".js", ".mjs", ".cjs", ".java", ".kt", ".py", ".go", ".rb", ".scala", ".cs", ".php", ".rs", ".c", ".h",
    ".swift", ".m", ".vue", ".svelte",
]
TEST_FILE = r"(?:^|[./_-])(?:test|spec|Test|Spec|IT)"
JAVA_CLASS = r"\b((?:[a-z][\w]{0,30}\.){1,8}[A-Z][\w$]{0,60}(?:Test|IT|Spec)?)\.[\w$<>]{1,60}\("
PYTEST_NODE = r"\b([\w./-]{1,160}\.py::[\w.:\[\]-]{1,120})"
BULLET_TITLE = r"^\s*●\s+(.{1,160})$"

# ---- fixed values: text that must not reach a published report --------------
REDACTIONS = [
    (r"https://dash\.cloudflare\.com/oauth2/auth\?\S+", "<redacted: cloudflare oauth url>"),
    (r"(?i)\b(bearer\s+)[A-Za-z0-9._~+/-]{20,}=*", "$1<redacted>"),
    (r"\b[A-Za-z0-9_-]{24,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{20,}\b", "<redacted: jwt>"),
    (r"\bv1\.0-[A-Za-z0-9_-]{30,}", "<redacted: cf api token>"),
    (r"(?i)\b(api[_-]?(?:key|token)\s*[:=]\s*)['\"]?[A-Za-z0-9._~+/-]{16,}['\"]?", "$1<redacted>"),
]
SKIPPED_PROMPT_PREFIXES = [
    "<system-reminder>", "<command-name>", "<command-message>", "<local-command",
]
