"""The rules: id, severity, scanner, message, remediation, and the patterns that stand for them.

Ids, severities, patterns and word lists are fixed values: results must carry exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    scanner: str
    message: str
    remediation: str
    pattern: str | None = None


def _rules(scanner: str, *rows: tuple) -> tuple[Rule, ...]:
    return tuple(Rule(r[0], r[1], scanner, r[2], r[3], r[4] if len(r) > 4 else None) for r in rows)


KEYS = "Scripts have no business with key files; use tokens that the caller hands over"
ALLOW = "Add the domain to [allowlist.domains] of the configuration if it is meant"
DROP = "Take the sentence out of the instructions"

# Ids, severities and patterns.
BASH = _rules(
    "bash_patterns",
    ("bash/CAT-A1", "error", "Output is piped into a shell", "Save it, check its digest, then run it", r"(?i)\|\s*(?:/\S+/)?(?:env\s+)?(bash|sh|zsh|fish|ksh|dash)\b"),
    ("bash/CAT-A2", "error", "eval runs composed text", "Call functions or use a case statement", r"(?i)\beval\s*[\"'`\$\(]"),
    ("bash/CAT-A3", "error", "A remote script is sourced", "Save it, read it, then source the file", r"(?i)\bsource\s*<\s*\(\s*(curl|wget|fetch)"),
    ("bash/CAT-A4", "error", "A download to /tmp is run", "Install a verified release instead", r"(?i)(curl|wget).+/tmp/.+(?:&&|;)\s*(bash|sh|exec)"),
    ("bash/CAT-B1", "error", "SSH folder is read", KEYS, r"(\$\{?HOME\}?|~|/root|/home/[^/\s]+)/\.ssh/"),
    ("bash/CAT-B2", "error", "AWS folder is read", KEYS, r"(\$\{?HOME\}?|~|/root|/home/[^/\s]+)/\.aws/"),
    ("bash/CAT-B3", "error", "Kubernetes configuration is read", KEYS, r"(\$\{?HOME\}?|~|/root|/home/[^/\s]+)/\.kube/config"),
    ("bash/CAT-B4", "error", "A variable goes out in a request body", "Never post the environment", r"(?i)(curl|wget).+(-d\b|--data(?:-binary|-urlencode)?|--post-data)[\s=][\"']?[^\n]*\$"),
    ("bash/CAT-B5", "error", "The environment is piped to the network", "Never send the environment", r"(?i)\benv\b.+\|\s*(curl|wget|nc)"),
    ("bash/CAT-C1", "error", "Home or root is removed", "Remove named folders below a checked path", r"(?i)\brm\s+(-[rRfF]+\s+){0,3}(\$HOME|~/|/\s*$|\$\{HOME\})"),
    ("bash/CAT-C2", "error", "A device is overwritten", "Leave block devices alone", r"(?i)\bdd\s+if=/dev/(urandom|zero|random)\s+of=/dev/"),
    ("bash/CAT-D1", "error", "netcat hands out a shell", "Remove it at once", r"(?i)\b(nc|ncat)\s+(-[a-zA-Z]+\s+)*(-e|--exec)\s+/bin/"),
    ("bash/CAT-D2", "error", "A shell is tied to /dev/tcp", "Remove it at once", r"(?i)(bash\s+-i\s+>&?\s*/dev/tcp/|exec\s+\d+[<>]+/dev/tcp/|<>/dev/tcp/)"),
    ("bash/CAT-D3", "error", "A Python one-liner opens a socket", "Remove it at once", r"(?i)python\S*\s+-c\s+.*socket.*connect"),
    ("bash/CAT-E1", "warning", "sudo opens a shell", "Name the one command that needs root", r"(?i)\bsudo\s+(su|bash|sh)\b"),
    ("bash/CAT-E2", "warning", "A set-user-id bit is set", "Leave mode bits plain", r"\bchmod\s+(?:[ugoa]*\+[ugoa]*s|0?[2467][0-7]{3})\b"),
    ("bash/CAT-G1", "warning", "rm of an unquoted variable", "Quote it and check that it is set", r"(?i)\brm\s+-[rRfF]+\s+\$[a-zA-Z_][a-zA-Z0-9_]*(?:[^/\"\{]|$)"),
    ("bash/CAT-G2", "warning", "A shell runs a variable", "Call commands by name", r"(?i)(bash|sh)\s+-c\s+[\"']?\$[a-zA-Z_]"),
    ("bash/CAT-H1", "info", "A request to a domain that is not listed", ALLOW, r"(?i)(curl|wget)\s+https?://"),
)
TYPESCRIPT = _rules(
    "typescript_patterns",
    ("typescript/CAT-A1", "error", "eval() runs composed text", "Use JSON.parse or a switch", r"(?:^|[^.a-zA-Z_$])eval\s*\("),
    ("typescript/CAT-A2", "error", "new Function() makes code at run time", "Use a table of functions", r"\bnew\s+Function\s*\("),
    ("typescript/CAT-B1", "warning", "child_process is imported", "Use a typed client", r"(?i)(?:require\s*\(\s*['\"]child_process['\"]|from\s+['\"]child_process['\"])"),
    ("typescript/CAT-B2", "warning", "A command is run synchronously", "Use a typed client", r"\b(?:execSync|spawnSync|execFileSync)\s*\("),
    ("typescript/CAT-B3", "info", "A call that may run a command", "Use a typed client, or mark the line if it is something else", r"(?:^|[^.a-zA-Z_$])(?:exec|execFile|spawn)\s*\("),
    ("typescript/CAT-C1", "error", "An SSH key path", KEYS, r"(?i)\.ssh[/\\](?:id_rsa|id_ed25519|id_ecdsa|id_dsa|id_xmss|authorized_keys|known_hosts)"),
    ("typescript/CAT-C2", "error", "An AWS credentials path", KEYS, r"(?i)\.aws[/\\]credentials"),
    ("typescript/CAT-C3", "error", "A Kubernetes configuration path", KEYS, r"(?i)\.kube[/\\]config"),
    ("typescript/CAT-D1", "error", "A raw socket is opened", "Talk HTTPS only", r"(?i)\bnet\.(?:createConnection|createServer|connect|Socket)\s*\("),
    ("typescript/CAT-H1", "info", "A request to a domain that is not listed", ALLOW, r"(?i)(?:fetch|axios\.(?:get|post|put|delete|patch|head|request)|got\.(?:get|post|stream)|ky\.(?:get|post|put|delete|patch))\s*\(\s*['\"`]https?://"),
)
PROMPT = _rules(
    "prompt",
    ("prompt/override-ignore", "error", "Tells the model to ignore its instructions", DROP, r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)"),
    ("prompt/override-disregard", "error", "Tells the model to disregard its instructions", DROP, r"(?i)disregard\s+(all\s+)?(previous|prior|above|your)\s+(instructions?|prompts?|rules?|guidelines?)"),
    ("prompt/override-forget", "error", "Tells the model to forget what it was told", DROP, r"(?i)forget\s+(everything|all|what)\s+(you|i)\s+(told|said|know)"),
    ("prompt/role-escalation", "error", "Gives the model an administrator's role", DROP, r"(?i)you\s+are\s+(now\s+)?(a|an|the)\s+(root|admin|system|super)\s*(user|administrator)?"),
    ("prompt/role-impersonation", "warning", "Gives the model another identity", DROP, r"(?i)pretend\s+(to\s+be|you('re| are))\s+(a\s+)?(different|another|new)\s+(ai|assistant|system)"),
    ("prompt/restrictions-bypass", "error", "Lifts the model's restrictions", DROP, r"(?i)act\s+as\s+(if\s+)?(you\s+)?(have\s+)?(no|without)\s+(restrictions?|limits?|rules?)"),
    ("prompt/jailbreak-dan", "error", "A known jailbreak by its name", DROP, r"(?i)(DAN|do\s+anything\s+now)\s+mode"),
    ("prompt/jailbreak-devmode", "error", "Turns on a developer mode", DROP, r"(?i)developer\s+mode\s+(enabled?|activate|on)"),
    ("prompt/jailbreak-bypass", "error", "Asks to bypass a safety check", DROP, r"(?i)bypass\s+(safety|security|content)\s+(filter|check|restriction)s?"),
    ("prompt/exfil-send", "warning", "Asks to send data out", DROP, r"(?i)(send|post|transmit|exfiltrate)\s+.{0,30}(to|via)\s+(http|https|webhook|url|endpoint)"),
    ("prompt/exfil-read", "warning", "Asks to read credentials", DROP, r"(?i)(read|access|get|extract)\s+.{0,20}(password|secret|key|token|credential)s?"),
    ("prompt/inject-execute", "error", "Asks to run any code", DROP, r"(?i)execute\s+(any|arbitrary|untrusted)\s+(code|command|script)s?"),
    ("prompt/inject-unvalidated", "error", "Asks to run without checks", DROP, r"(?i)run\s+.{0,20}without\s+(checking|validation|sanitiz)"),
    ("prompt/perm-delete-all", "warning", "Asks to delete everything", DROP, r"(?i)\b(delete|remove|rm)\s+(-[rfRF]{1,4}\s+)?(/|~/|\.\./|\*|all\b|everything\b)"),
    ("prompt/perm-sudo", "warning", "Asks for root", DROP, r"(?i)\bsudo\b|as\s+root|with\s+(elevated|admin)\s+priv"),
    ("prompt/exfil-sysPrompt", "error", "Asks for the hidden instructions", DROP, r"(?i)(repeat|print|show|reveal|output|display)\s+(your\s+)?(system\s+prompt|initial\s+instructions?|prompt\s+template|base\s+instructions?)"),
    ("prompt/inject-delimiter", "error", "Holds a model's own delimiters", DROP, r"(?i)(</?(?:instructions?|system|prompt)>|\[/?INST\]|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|(?:begin_of_text|end_of_text|start_header_id|end_header_id|eot_id)\|>)"),
    ("prompt/jailbreak-fiction", "warning", "Wraps a request in fiction", DROP, r"(?i)(for\s+a\s+fictional\s+(story|scenario)|hypothetically\s+speaking|in\s+a\s+(simulation|hypothetical|fictional)\s+(scenario|world|context)|let('s|\s+us)\s+pretend|imagine\s+(you\s+are|that\s+you\b))"),
    ("prompt/override-priority", "warning", "Claims priority by a keyword", DROP, r"(?i)\b(OVERRIDE|NEW\s+TASK|SYSTEM\s+OVERRIDE):\s*"),
)
REGISTRY = "Name the registry on the command line"
PACKAGE = _rules(
    "package_install",
    ("pkg/F1-npm", "warning", "npm installs from the default registry", REGISTRY, r"(?i)\bnpm\s+(install|i|add)\b"),
    ("pkg/F1-bun", "warning", "bun installs from the default registry", REGISTRY, r"(?i)\bbun\s+(add|install)\b"),
    ("pkg/F1-pip", "warning", "pip installs from the default index", "Name the index on the command line", r"(?i)\bpip3?\s+install\b"),
    ("pkg/F1-yarn", "warning", "yarn installs from the default registry", REGISTRY, r"(?i)\byarn\s+(add|install)\b"),
    ("pkg/F1-pnpm", "warning", "pnpm installs from the default registry", REGISTRY, r"(?i)\bpnpm\s+(add|install|i)\b"),
    ("pkg/F2-unpinned", "warning", "The latest version is installed", "Pin a version", r"@latest\b"),
    ("pkg/F3-registry", "warning", "A registry that is not listed", "Add it to [allowlist.registries] of the configuration if it is meant", r"(?i)--registry[=\s](https?://\S+)"),
)
HAS_REGISTRY = r"(?i)--registry[=\s]"
HAS_INDEX = r"(?i)(--index-url\s|-i\s)"
URLS = _rules(
    "malicious_urls",
    ("url/U1-shortener", "warning", "A shortener hides the address", "Write the address itself"),
    ("url/U2-paste", "error", "An address at a paste site", "Fetch from a versioned, signed place"),
    ("url/U3-ip-literal", "warning", "An IP address for a host", "Write a host name"),
    ("url/U4-suspicious-tld", "warning", "A top-level domain that is often abused", "Check that the address is meant"),
    ("url/U5-non-https", "warning", "An address without TLS", "Use https"),
)
OBFUSCATION = _rules(
    "obfuscation",
    ("obfusc/O1-base64", "warning", "A base64 token in prose", "Put it in a fence, or write what it says"),
    ("obfusc/O2-hex-blob", "warning", "A hexadecimal token in prose", "Put it in a fence"),
    ("obfusc/O3-high-entropy", "warning", "A token of high entropy in prose", "Put it in a fence, or name it"),
)
PII = _rules(
    "pii",
    ("pii/P1-email", "warning", "An email address", "Use a placeholder"),
    ("pii/P2-ssn", "error", "A social security number", "Remove it"),
    ("pii/P3-credit-card", "error", "A card number", "Remove it"),
    ("pii/P4-private-ipv4", "info", "A private IPv4 address", "Move it to the configuration"),
    ("pii/P5-internal-host", "warning", "An internal host name", "Move it to the configuration"),
)
SCRIPTS = _rules(
    "script_mixing",
    ("script/SM1-homoglyph", "warning", "A letter that looks like a Latin one", "Write the Latin letter"),
    ("script/SM2-bidi-override", "error", "A sign that turns the direction of text", "Remove it"),
    ("script/SM3-mixed-scripts", "warning", "A field that mixes scripts", "Write Latin letters only"),
)


def _document_rules(prefix: str, scanner: str, kind: str, tail: tuple[tuple, ...]) -> tuple[Rule, ...]:
    """Rules that both kinds of metadata share, under their own prefixes."""
    shared = (
        (f"{prefix}/xml-in-frontmatter", "error", "Markup in a metadata field", "Take the brackets out"),
        (f"{prefix}/name-reserved-word", "error", "A reserved word in the name", "Choose another name"),
        (f"{prefix}/invalid-name-format", "warning", "A name with capitals, spaces or underscores", "Use lower case and hyphens"),
        (f"{prefix}/name-too-long", "warning", "A name of over 64 characters", "Shorten it"),
        (f"{prefix}/name-too-vague", "warning", "A name of a vague word", "Say what it does"),
        (f"{prefix}/description-missing", "warning", "No description", "Write one"),
        (f"{prefix}/description-too-long", "warning", "A description of over 1024 characters", "Shorten it"),
        (f"{prefix}/description-not-third-person", "warning", "A description in the first or second person", "Write it in the third"),
        (f"{prefix}/{kind}-body-too-long", "warning", "A file of over 500 lines", "Shorten it"),
        (f"{prefix}/windows-path", "warning", "A path with backslashes", "Use slashes"),
        (f"{prefix}/description-no-trigger", "info", "A description that does not say when to use it", "Say when to use it"),
        (f"{prefix}/time-sensitive-content", "warning", "A condition on a date", "Take dated content out"),
        (f"{prefix}/name-directory-mismatch", "warning", "A name that differs from the folder's", "Rename one of them"),
        (f"{prefix}/name-leading-trailing-hyphen", "warning", "A hyphen at an end of the name", "Remove it"),
        (f"{prefix}/name-consecutive-hyphens", "warning", "Two hyphens in a row in the name", "Use one"),
    )
    return _rules(scanner, *shared, *tail)


FRONTMATTER = _document_rules(
    "frontmatter", "frontmatter", "skill",
    (
        ("frontmatter/missing-skill-md", "error", "No SKILL.md at the root", "Write one"),
        ("frontmatter/readme-in-skill", "warning", "A README.md beside SKILL.md", "Move it into the description"),
        ("frontmatter/bare-bash-tool", "warning", "Bash without limits among the tools", "Name the commands that it may run"),
        ("frontmatter/compatibility-too-long", "warning", "A compatibility field of over 500 characters", "Shorten it"),
    ),
)
AGENT = _document_rules(
    "agent", "agent_frontmatter", "agent",
    (
        ("agent/missing-agent-md", "error", "No AGENT.md at the root", "Write one"),
        ("agent/system-prompt-injection", "error", "The system prompt overrides instructions", "Take the sentence out"),
        ("agent/model-not-specified", "warning", "No model is named", "Name one"),
        ("agent/bare-tool", "warning", "Bash without limits among the tools", "Name the commands that it may run"),
        ("agent/system-prompt-too-long", "warning", "A system prompt of over 8000 characters", "Shorten it"),
        ("agent/unconstrained-mcp-server", "warning", "A server with all its tools", "Name the tools that it may use"),
    ),
)
WIKI = "See https://www.shellcheck.net/wiki/"
SHELLCHECK = _rules(
    "shellcheck",
    ("shellcheck/SC2086", "info", "An unquoted expansion", WIKI + "SC2086"),
    ("shellcheck/SC2046", "warning", "An unquoted substitution", WIKI + "SC2046"),
    ("shellcheck/SC2006", "warning", "Backticks", WIKI + "SC2006"),
    ("shellcheck/SC2039", "warning", "Not in POSIX sh", WIKI + "SC2039"),
    ("shellcheck/SC2059", "info", "A variable in a printf format", WIKI + "SC2059"),
)
SEMGREP = _rules(
    "semgrep",
    ("semgrep/javascript.express.security.audit.xss.direct-response-write.direct-response-write", "error", "A response is written unescaped", "Escape it"),
    ("semgrep/python.lang.security.audit.dangerous-spawn-process.dangerous-spawn-process", "error", "A process is spawned from text", "Pass a list of arguments"),
    ("semgrep/bash.curl.security.curl-pipe-bash.curl-pipe-bash", "error", "A download is piped into a shell", "Check it first"),
)
READ_ERRORS = tuple(Rule(f"{p}/read-error", "info", s, "A file can't be read", "Check its size and encoding") for p, s in (("bash", "bash_patterns"), ("prompt", "prompt"), ("typescript", "typescript_patterns")))

#: Scanners in the order in which their findings come, for each kind of artifact.
_LINES = ("prompt", "bash_patterns", "typescript_patterns", "package_install", "malicious_urls", "obfuscation", "pii", "script_mixing")
_TOOLS = ("shellcheck", "secrets", "semgrep")
ORDER = {"skill": (*_LINES, "frontmatter", *_TOOLS), "agent": (*_LINES, "agent_frontmatter", *_TOOLS)}
LINE_RULES = (*BASH, *TYPESCRIPT, *PROMPT, *PACKAGE, *URLS, *OBFUSCATION, *PII, *SCRIPTS)
COMMON = (*LINE_RULES, *SHELLCHECK, *SEMGREP)
ALL = (*COMMON, *FRONTMATTER, *AGENT)

# Word lists.
DOMAINS = ("registry.npmjs.org", "npmjs.org", "github.com", "githubusercontent.com", "pypi.org")
REGISTRIES = ("registry.npmjs.org", "pypi.org", "files.pythonhosted.org")
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "lnkd.in", "shorturl.at", "rb.gy", "cutt.ly")
PASTE_SITES = ("pastebin.com", "paste.ee", "ghostbin.com", "hastebin.com", "dpaste.org", "termbin.com", "transfer.sh", "0x0.st", "file.io", "ix.io")
ABUSED_TLDS = ("tk", "top", "xyz", "gq", "ml", "cf")
EXAMPLE_DOMAINS = ("example.com", "example.org", "example.net", "example.edu", "test.com", "test.org", "localhost", "domain.com", "email.com", "mail.com")
EXAMPLE_SUFFIXES = (".example", ".test", ".invalid", ".localhost")
EXAMPLE_LOCALS = ("noreply", "no-reply", "donotreply", "do-not-reply", "user", "username", "you")
VAGUE_NAMES = ("helper", "utils", "tools", "data", "files", "documents")
TRIGGERS = ("use when", "when the user", "when working with", "when asked", "when you need", "trigger", "invoke when", "should be used when", "when users", "when a user", "use it when", "useful when")
BENIGN_STEMS = ("license", "licence", "changelog", "notice", "authors", "contributors", "copying", "patents", "version", "history")
#: Look-alike code points and the Latin letters that they stand for.
HOMOGLYPHS = {
    0x3BF: "o", 0x3BD: "v", 0x3C4: "t", 0x3C1: "p", 0x3B1: "a", 0x3B2: "b", 0x3B5: "e", 0x3B6: "z", 0x3B7: "n", 0x3BA: "k", 0x3BB: "l", 0x3BC: "u", 0x3C3: "s", 0x3C2: "s", 0x3C7: "x", 0x3C8: "y",
    0x430: "a", 0x435: "e", 0x43E: "o", 0x440: "p", 0x441: "s", 0x443: "u", 0x445: "h", 0x43D: "n", 0x432: "b", 0x43C: "m",
    0x26A: "i", 0x1D1B: "t",
}

# Other patterns.
EMAIL = r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"
SSN = r"\b(\d{3})-(\d{2})-(\d{4})\b"
CARD = r"\b(?:\d[ -]?){12,18}\d\b"
IPV4 = r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b"
INTERNAL_HOST = r"(?i)\b([a-z0-9][a-z0-9\-]{0,62}(?:\.[a-z0-9][a-z0-9\-]{0,62})*)\.(internal|corp|local|lan|intranet)\b"
URL = r"(?i)(https?)://(?:[^@/?#\s]+@)?(\[[0-9a-fA-F:]+\]|[^/?#:\s]+)(?::\d+)?([^\s'\"`<>)]*)"
IP_HOST = r"^(?:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|\[[0-9a-fA-F:]+\])$"
FIRST_PERSON = r"(?i)\b(I can|I will|I'll|I am|I'm|you can|you should|you will|you'll)\b"
WINDOWS_PATH = r"[a-zA-Z]:\\|[a-zA-Z0-9_][\\][a-zA-Z0-9_]"
TIME = r"(?i)\b(before|after|until|since|as of|by)\s+\w*\s*(january|february|march|april|may|june|july|august|september|october|november|december)?\s*\d{4}\b"
SYSTEM_INJECTION = r"(?i)\b(ignore\s+(all\s+)?previous\s+instructions?|disregard\s+(all\s+)?instructions?|override\s+all|jailbreak|you\s+are\s+now\s+a\s+different)\b"
#: Names of the inline marks that drop a line, after # and after //; a configuration may add the name of its own tool.
HASH_MARKS, SLASH_MARKS = ("scan", "audit"), ("audit",)
IGNORE_HASH = r"(?i)\s*#\s*(scan|audit):ignore\s*$"
IGNORE_SLASHES = r"(?i)//\s*(audit):ignore\s*$"
#: What redaction writes for each kind of match, in this order.
REDACTIONS = ((EMAIL, "<redacted email>"), (SSN, "XXX-XX-XXXX"), (CARD, "<redacted credit card>"), (IPV4, "<redacted private ipv4>"), (INTERNAL_HOST, "<redacted internal hostname>"))
