"""Vocabulary of the rules: patterns, word lists and limits.

FIXED VALUES: everything in this file must equal the published behaviour for results to match.
Word characters are spelled out as Unicode classes because Java's and RE2's ``\\w`` is ASCII.
The same strings are used by Spark and by the SQL oracle.
"""

W = r"\p{L}\p{N}_"

# ---- references -------------------------------------------------------------------------------
URL = rf"https?://[{W}.\-]+(?::\d+)?[{W}./\-#?=&%]*"
PATH = rf"(?:\.\./|\./|/Users/|~/)[{W}./\-\[\]]+"
REPO = rf"github\.com/[{W}.\-]+/[{W}.\-]+"
ENDPOINT = (
    r"/(?:clients?|cases?|users?|oauth|authorization|instructions|answers|hash)"
    rf"[{W}{{}}/\-]*"
)

# ---- rule families ----------------------------------------------------------------------------
NO_CRITERION = (
    r"(?i)as (?:clean|good|abstract|nice)\b.{0,40}as possible"
    r"|as many times as it takes|make it (?:nice|good|better)|do it all over again"
)
ABSOLUTE = (
    r"(?i)\b(?:no|never|only|don'?t|must not)\b.{0,40}"
    r"\b(?:more|screen|branching|notification|report|option)s?\b"
)
NEGATION = (
    r"(?i)\b(?:shouldn'?t|should not|isn'?t|is not|don'?t|do not|no longer|never|not)\b"
)

# ---- signal families (name, pattern) ----------------------------------------------------------
CORRECTION = (
    r"(?i)\b(?:there (?:are|is) no|no longer|should(?:n'?t| not) be|has been changed"
    r"|have been changed|is now|are now|not correct|incorrect|wrong|instead of"
    r"|replaced|deprecated|legacy|we moved away|moved to|is really"
    r"|i (?:meant|said)|actually)\b"
)
STATE_QUESTION = (
    r"(?i)\b(?:still (?:running|going)|stuck|hung|frozen|finished yet"
    r"|have you (?:stopped|finished)|is it (?:done|working|running)"
    r"|taking (?:this|so) long|any progress|what'?s happening)\b"
)
REPEAT = (
    r"(?i)\b(?:again|already (?:said|told|asked)|as i said|like i said"
    r"|you keep|still (?:not|hasn'?t|doesn'?t|isn'?t))\b"
)
MISREAD = (
    r"(?i)\b(?:that'?s not what|thats not what|i didn'?t ask"
    r"|not what i (?:asked|meant|said)|why (?:did|are) you)\b"
)
SCOPE_CREEP = (
    r"(?i)\b(?:i only asked|you'?ve gone|such trouble|too much"
    r"|over[- ]?engineer|simpler|scale it back|out of scope)\b"
)
UNDO = (
    r"(?i)\b(?:revert|undo|roll ?back|put it back|discard (?:that|those)"
    r"|start again|from scratch)\b"
)
SIGNALS = (
    ("correction", CORRECTION),
    ("repeat/re-ask", REPEAT),
    ("state-ask", STATE_QUESTION),
    ("misread", MISREAD),
    ("scope-creep", SCOPE_CREEP),
    ("undo", UNDO),
)

# ---- machine-written text ---------------------------------------------------------------------
SYSTEM_PREFIX = (
    r"^\s*<(?:task-notification|bash-|local-command|system-reminder|command-name)"
)
INTERRUPT = r"^\[Request interrupted"
NOTIFICATION_TAG = "<task-notification>"
TOOL_USE_ID = r"<tool-use-id>(.*?)</tool-use-id>"
TASK_ID = r"<task-id>(.*?)</task-id>"
BACKGROUND_ID = r"running in background with ID: ([A-Za-z0-9_-]+)"
OWN_ATTACHMENTS = ("hook_additional_context", "hook_system_message")
SNAPSHOT_NAME = r"^(.*)\.(\d+)\.transcript\.jsonl$"

# ---- tokens -----------------------------------------------------------------------------------
TOKEN = rf"[a-z_][{W}\-]{{3,}}"
STOP_WORDS = (
    "the a an and or of to in for on at is are be this that it with from you we i as by not but "
    "if then so please can could would should we're its it's have has had do does did will just "
    "now new one two"
).split()

# ---- reply verdicts ---------------------------------------------------------------------------
VERDICT_MAX_CHARS = 200
VERDICT_LEAD = (
    r"(?i)^[\s>*_`\-\"'(\[]*(?:ok(?:ay)?|well|hmm+|so|and|but|actually|right then)?[\s,.:;!]*"
)
AFFIRM = (
    "yes", "yep", "yeah", "yup", "correct", "right", "true", "confirmed", "agreed", "do it",
    "go ahead", "please do", "good catch", "true enough",
)
NEGATE = (
    "no", "nope", "nah", "ignore", "skip", "wrong", "incorrect", "false", "irrelevant",
    "disregard", "not relevant", "never mind", "nevermind", "don't", "dont", "do not",
    "false alarm", "not now",
)

# ---- limits -----------------------------------------------------------------------------------
# Limits that bound one machine's memory. None: no limit, every row and every character counts.
MESSAGE_MAX_CHARS = None
MAX_QUEUE_OPS = None
REQUEST_MAX_CHARS = None
MAX_ASKS_PER_SESSION = 5
FIRST_MESSAGE_PLACEHOLDER = "(no earlier message)"
PRECISION_CEILING = 0.8
PRECISION_FLOOR = 0.30
TRUSTED_BASIS = "auto"
DEFAULT_PARAMS = {
    ("R01", "min_chars"): 20.0,
    ("R01", "compare_chars"): 0.0,
    ("R01", "similarity"): 0.55,
    ("R07", "min_chars"): 25.0,
    ("R07", "compare_chars"): 0.0,
    ("R07", "similarity"): 0.85,
    ("R07", "window_s"): 120.0,
    ("R12", "window_s"): 90.0,
}

# ---- how each rule's fires are judged; which rules say nothing about a message -----------------
BASIS = {
    "R01": "tautological", "R02": "tautological", "R03": "tautological", "R04": "auto-proxy",
    "R05": "hindsight", "R06": "hindsight", "R07": "auto", "R08": "none", "R09": "none",
    "R10": "auto", "R11": "manual", "R12": "auto", "R13": "none",
}
CONTENT_BLIND = ("R03", "R05")
ALWAYS = ("R13",)
FORMS = ("hedged", "understated", "interrogative", "optative")
DESYNC_KINDS = (
    "correction", "re-report", "state-question", "misread", "scope", "undo", "none",
)
CONFIDENCE = ("low", "medium", "high")
STRENGTHS = ("direct", "weakened", "none")
CAPTURE_EVENTS = (
    "SessionStart", "PreCompact", "PostCompact", "SessionEnd", "Stop", "PostToolUse",
    "PostToolUseFailure",
)
