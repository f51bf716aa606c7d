"""Limits, word lists and patterns that decide the results.

Patterns are in the Java dialect, as Spark's regexp functions use it.
"""

# Size limits of one output text.
MAX_BYTES = 500_000
MAX_LINES = 500
KEEP_HEAD = 200
KEEP_TAIL = 50

# White space as Python's str.strip and str.split see it; Java's \s is smaller.
WS_CHARS = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{WS_CHARS}]"
NWS = f"[^{WS_CHARS}]"
WS_TEXT = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Line ends as Python's str.splitlines sees them.
LINE_ENDS = "\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029"
LINE_END = r"[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"
NO_LINE_END = r"[^\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"
LINE = rf"{NO_LINE_END}*+(?:\r\n|{LINE_END})|{NO_LINE_END}++"

# Terminal escapes: colour and cursor codes, OSC up to BEL, charset switches.
ESC = "\x1b"
OSC = "\x1b]"
BEL = "\x07"
ANSI = r"\x1b\[[0-9;]*[mGKHF]|\x1b\][^\x07]*\x07|\x1b[()][AB012]"

# Likely secrets.
SECRET = (
    r"(?iu)(?:api[_-]?key|secret|token|password|passwd|auth)[^\n]{0,4}[:=]"
    + WS + r"*['\"]?[A-Za-z0-9+/=_\-]{16,}"
    r"|sk-[A-Za-z0-9]{32,}"
    r"|gh[pousr]_[A-Za-z0-9]{36,}"
    r"|AKIA[A-Z0-9]{16}"
    r"|eyJ[A-Za-z0-9_\-]{20,}"
)
# Every match of SECRET holds one of these in lower case, or one of the letters
# that equal s or i when case is ignored; cheap to look for first.
SECRET_HINTS = [
    "api", "secret", "token", "passw", "auth", "sk-",
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "akia", "eyj",
    "\u017f", "\u0131", "\u0130",
]

# Command families and the lines each one folds.
FAMILY_COMMANDS = {
    "diff": ["git"],
    "build": ["cargo", "rustc"],
    "test": ["pytest", "python", "python3"],
    "package": ["npm", "yarn", "pnpm", "bun"],
}
OTHER_FAMILY = "other"
BUILD_PREFIX = "   Compiling "
PACKAGE_LINE = r"\A(npm WARN|added \p{Nd}|packages? are|found \p{Nd})"
TEST_MARKERS = ["FAILED ", "ERROR ", "=====", "_____", "short test summary"]
TEST_PASSED = "PASSED "
TEST_KEEP_START = "collected"
TEST_KEEP_CONTAINS = ["passed", "failed"]
TEST_KEEP_PREFIX = ["platform", "rootdir"]

# Tools that run shell commands.
SHELL_TOOLS = [
    "bash", "shell", "terminal",
    "run_terminal_command", "run_shell_command", "execute_bash",
]

# Commands that talk to a terminal.
INTERACTIVE = [
    "vim", "vi", "nvim", "nano", "emacs", "pico",
    "less", "more", "man",
    "ssh", "telnet", "sftp", "ftp",
    "python", "python3", "ipython", "bpython",
    "node", "deno",
    "irb", "pry", "iex", "ghci",
    "psql", "mysql", "sqlite3", "mongo", "redis-cli",
    "top", "htop", "btop", "atop",
    "watch", "tmux", "screen",
]
WATCH_FLAGS = ["--watch", "-w "]
SHELL_OPS = ["&&", "||", " | ", "$(", "`", "<<", ">>"]
REDIRECTS = [" > ", " < ", " 2> ", " &> "]

# Commands that read a file into view.
FILE_READERS = ["cat", "head", "tail", "less", "bat", "read"]
