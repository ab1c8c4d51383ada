"""Word lists, patterns and constants that results depend on."""

from __future__ import annotations

#: English stop words as the NLTK project publishes them (nltk_data, corpora/stopwords, english).
ENGLISH_STOPS = tuple("""
a about above after again against ain all am an and any are aren aren't as at be because been before being below between both but by can couldn
couldn't d did didn didn't do does doesn doesn't doing don don't down during each few for from further had hadn hadn't has hasn hasn't have haven
haven't having he he'd he'll her here hers herself he's him himself his how i i'd if i'll i'm in into is isn isn't it it'd it'll it's its itself
i've just ll m ma me mightn mightn't more most mustn mustn't my myself needn needn't no nor not now o of off on once only or other our ours
ourselves out over own re s same shan shan't she she'd she'll she's should shouldn shouldn't should've so some such t than that that'll the their
theirs them themselves then there these they they'd they'll they're they've this those through to too under until up ve very was wasn wasn't we
we'd we'll we're were weren weren't we've what when where which while who whom why will with won won't wouldn wouldn't y you you'd you'll your
you're yours yourself yourselves you've
""".split())
#: Stop words of the domain, tested on cleaned, unstemmed tokens.
DOMAIN_STOPS = (
    "vulnerability", "vulnerabilities", "issue", "issues", "advisory", "advisories", "update", "updated", "updates", "securely",
    "allow", "allows", "allowed", "allowing", "affect", "affecting", "affects", "product", "products", "adversary", "adversaries",
    "technique", "techniques", "may", "use", "used", "using", "via", "also", "well", "example", "examples", "following", "specific",
    "various", "however", "therefore", "thus", "although", "whether", "within", "without", "across", "further", "nvdcwenoinfo",
    "nvdcweother", "nvdcwenoapplicable", "commonvulnerabilityexposure", "resolved", "rejected", "withdrawn", "candidate",
)
#: Further stop words of the topic model.
TOPIC_STOPS = (
    "fix", "fixed", "fixes", "patch", "patched", "call", "called", "make", "makes", "made", "lead", "leads", "cause", "causes",
    "allow", "allows", "allowed", "could", "would", "should", "prior", "need", "needs", "check", "checks", "due", "set", "sets",
    "get", "gets", "use", "used", "uses", "include", "includes", "contain", "contains", "provide", "none", "note", "known", "public",
    "record", "number", "result", "issue", "state", "type", "name", "list", "version", "update", "exist", "occur", "happen", "early",
    "late", "base", "refer", "reject", "resolve", "reserve", "common", "possible", "reason", "require", "application", "component",
    "function", "endpoint", "request", "response", "data", "information", "access", "commonvulnerabilityexposure",
    "remotecodeexecution", "localprivilegeescalation", "denialofservice", "crosssitescripting", "sqlinjection",
)
#: Acronyms written out at ingest.
ACRONYMS = {
    "rce": "remotecodeexecution", "lpe": "localprivilegeescalation", "sqli": "sqlinjection", "xss": "crosssitescripting",
    "csrf": "crosssiterequestforgery", "ssrf": "serversiderequestforgery", "lfi": "localfileinclusion", "rfi": "remotefileinclusion",
    "dos": "denialofservice", "ddos": "distributeddenialofservice", "mitm": "maninthemiddle", "ttp": "tacticstechniquesprocedures",
    "ioc": "indicatorofcompromise", "c2": "commandcontrol", "poc": "proofofconcept", "cve": "commonvulnerabilityexposure",
    "cwe": "commonweaknessenumeration", "cvss": "commonvulnerabilityscore",
}
#: Identifiers in texts, in the order in which they are taken out.
ID_PATTERNS = (r"(?i)\bCVE-\d{4}-\d+\b", r"(?i)\bCWE-\d+\b", r"(?i)\bCAPEC-\d+\b", r"\bT\d{4}(?:\.\d{3})?\b", r"\bTA\d{4}\b", r"(?i)\bMS\d{2}-\d+\b")
#: A token that is an identifier; the same for topics.
ID_TOKEN = r"(?i)^(CVE-\d{4}-\d+|CWE-\d+|CAPEC-\d+|T\d{4}(?:\.\d{3})?|TA\d{4}|MS\d{2}-\d+)$"
TOPIC_ID_TOKEN = r"(?i)^(CVE-\d{4}-\d+|CWE-\d+|T\d{4}(\.\d{3})?|TA\d{4})$"
#: What cleaning takes out of a token, in order.
CLEAN = (r"https?://\S+|www\.\S+|\S+\.(com|org|net|edu|gov|uk|io)\S*", r"&[a-z]+;", r"<.*?>", r"lt;.*?gt;?", r"</?\w+gt", r"[@#$<>\[\]_]")
#: What the topic model takes out of a text, in order.
TOPIC_MARKUP = (r"<.*?>", r"&[a-z]+;", r"https?://\S+")
PUNCTUATION = r"!-/:-@\[-`{-~"
#: White space as Python's str.split takes it, for SQL.
WHITE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Digits as Python's str.isdigit takes them, for SQL: decimal digits and these.
DIGIT = (r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}"
         r"\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]")
#: Scoring and expansion.
K1, B, ATTACK_WEIGHT, TECHNIQUE_WEIGHT, CVE_WEIGHT, MIN_KEYWORD, MIN_OVERLAP = 1.5, 0.75, 1.3, 0.6, 0.4, 4, 3


def index_stops() -> frozenset[str]:
    return frozenset((*ENGLISH_STOPS, *DOMAIN_STOPS))


def topic_stops() -> frozenset[str]:
    return frozenset((*ENGLISH_STOPS, *TOPIC_STOPS))
