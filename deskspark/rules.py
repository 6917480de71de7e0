"""Word lists, patterns and wording that decide results.

Order matters in every list. Operators take them as parameters; these are the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: categories -------------------------------------------------------------
CATEGORIES = (
    "technical_support", "product_inquiry", "billing", "feature_request", "feedback", "unrelated",
)
PRIORITIES = ("low", "medium", "high")
FEEDBACK_CATEGORIES = ("feedback", "feature_request")

# Mail category -> knowledge-base category; anything else maps to itself.
CORPUS_CATEGORY = {
    "technical_support": "technical",
    "product_inquiry": "general",
    "billing": "billing",
    "integration": "integration",
}


@dataclass(frozen=True)
class LadderRule:
    """One rung of the keyword ladder; the first rung with a hit decides."""

    category: str
    terms: tuple[str, ...]
    confidence: float
    reasoning: str
    priority: str
    high_terms: tuple[str, ...] = ()


# ---- fixed values: keyword ladder ---------------------------------------------------------
LADDER = (
    LadderRule(
        "technical_support",
        ("login", "password", "access", "error", "bug", "crash", "not working", "broken", "reset",
         "can't", "cannot"),
        0.7, "Keyword-based classification: Technical issue detected", "medium",
        ("urgent", "asap", "critical", "can't access"),
    ),
    LadderRule(
        "billing",
        ("billing", "charge", "payment", "invoice", "refund", "subscription", "cancel"),
        0.75, "Keyword-based classification: Billing issue detected", "medium",
        ("charged twice", "wrong amount", "didn't receive"),
    ),
    LadderRule(
        "feature_request",
        ("feature request", "suggestion", "would be nice", "please add", "could you add"),
        0.7, "Keyword-based classification: Feature request detected", "low",
    ),
    LadderRule(
        "feedback",
        ("love", "great", "thank", "feedback", "disappointed", "frustrated"),
        0.65, "Keyword-based classification: Feedback detected", "low",
    ),
)
LADDER_DEFAULT = LadderRule(
    "product_inquiry", (), 0.6, "Keyword-based classification: General inquiry (fallback)", "medium",
)

# ---- fixed values: account lookup and escalation ------------------------------------------
ACCOUNT_TERMS = (
    "subscription", "plan", "billing", "invoice", "payment", "account", "membership", "upgrade",
    "downgrade", "cancel", "charge", "refund", "receipt", "transaction", "balance", "usage",
    "limit", "quota", "tier",
)
ESCALATION_TERMS = (
    "escalat", "escalating", "escalate to", "specialist", "specialist will", "billing team",
    "technical team", "technical specialist", "product team", "support team", "review by",
    "forward to", "forwarding to", "manual review", "need to connect you",
    "reach out to you directly", "will contact you", "will be in touch", "within 24 hours",
    "dedicated",
)
AUTOMATED_SENDER_TERMS = ("noreply", "no-reply", "donotreply", "automated")
EXCLUDED_MAIL_TABS = ("promotions", "social", "forums")


@dataclass(frozen=True)
class ChunkRule:
    category: str
    priority: str
    content_terms: tuple[str, ...]
    file_terms: tuple[str, ...]


# ---- fixed values: chunk metadata ---------------------------------------------------------
CHUNK_RULES = (
    ChunkRule("billing", "high",
              ("billing", "payment", "invoice", "subscription", "price", "cost", "refund", "charge",
               "plan"),
              ("billing", "pricing")),
    ChunkRule("technical", "high",
              ("error", "problem", "issue", "troubleshoot", "fix", "resolve", "not working",
               "failed"),
              ("troubleshooting", "error")),
    ChunkRule("integration", "medium",
              ("api", "integration", "webhook", "endpoint", "authentication", "oauth"),
              ("integration", "api")),
    ChunkRule("onboarding", "medium",
              ("getting started", "quick start", "first", "create", "setup", "installation"),
              ("getting", "start")),
)
CHUNK_DEFAULT = ("general", "low")
DOC_TYPES = (
    ("troubleshooting",
     ("## problem:", "## solution:", "### problem:", "troubleshooting", "error:")),
    ("guide", ("## quick start", "### step", "how to", "guide:")),
    ("api_reference", ("endpoint", "request", "response", "parameters", "api reference")),
    ("faq", ("faq", "question:", "frequently asked")),
)
DOC_TYPE_DEFAULT = "documentation"

# ---- fixed values: reply cleanup ----------------------------------------------------------
SALUTATIONS = ("Dear ", "Hi ", "Hello ", "Thank you for", "Thanks for")
SIGN_OFFS = (
    "Thanks,", "Best regards,", "Sincerely,", "Best,", "Warm regards,", "Kind regards,",
    "Regards,", "Thank you,",
)
TRAILING_NOTES = (
    "Note:", "Please note", "Please let me know", "This response", "The response",
    "Feel free to", "If you need any modifications", "---",
)
DIGEST_LEADS = ("Extracted feedback/feature:", "Feedback:", "Feature:")
CLOSING_NAME_LINES = ("Best", "Thanks", "Regards", "Sincerely", "-")

# ---- fixed values: personal data ----------------------------------------------------------
# (type, pattern, replacement token, severity)
PII_PATTERNS = (
    ("PHONE_NUMBER", r"\b(?:\+?1[-.]?)?\(?([0-9]{3})\)?[-.]?([0-9]{3})[-.]?([0-9]{4})\b",
     "[PHONE REDACTED]", "high"),
    ("CREDIT_CARD", r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "[CARD REDACTED]", "critical"),
    ("US_SSN", r"\b\d{3}-?\d{2}-?\d{4}\b", "[SSN REDACTED]", "critical"),
)
# Wider entity list; recognisers are patterns of our own.
PII_EXTENDED_PATTERNS = (
    ("PHONE_NUMBER", r"\+?1?[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}", "high"),
    ("CREDIT_CARD", r"\b(?:\d{4}[- ]?){3}\d{4}\b", "critical"),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b", "critical"),
    ("US_PASSPORT", r"\b[A-Z]\d{8}\b", "critical"),
    ("US_DRIVER_LICENSE", r"\b[A-Z]\d{7}\b", "high"),
    ("IBAN_CODE", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "high"),
    ("IP_ADDRESS", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "high"),
)

# ---- fixed values: safety and quality -----------------------------------------------------
TOXIC_TERMS = (
    "stupid", "idiot", "moron", "dumb", "hate", "worst", "useless", "garbage", "trash", "pathetic",
    "incompetent",
)
# supplied label -> (check_type, severity, message, action)
TOXIC_VERDICTS = {
    "SEVERE": ("toxic_language", "critical", "Severe toxic language detected", "block"),
    "MODERATE": ("toxic_language", "high", "Moderate toxic language detected", "block"),
    "MILD": ("unprofessional_language", "medium", "Mild unprofessional language detected", "flag"),
}
PLACEHOLDERS = (
    "[INSERT", "[TODO", "{{", "}}", "[NAME]", "[COMPANY]", "XXX", "[EMAIL]", "[PHONE]",
)
QUICK_PLACEHOLDERS = ("[PLACEHOLDER]", "[TODO]", "[INSERT", "XXX", "TBD")
QA_ESCALATION_TERMS = (
    "escalat", "specialist", "billing team", "technical team", "product team", "manual review",
)
GREETINGS = ("Dear", "Hi", "Hello")
EMPATHY_TERMS = ("understand", "appreciate", "apologize", "thank you for")
CLOSING_LINE = "hope you have a great day"
BLOCK_REASON = "Response blocked due to critical safety violations"

# ---- fixed values: query handling ---------------------------------------------------------
COMPLEX_MARKS = ("and", "also", "?", "but", "however", "additionally")
LIST_NUMBER = r"^\d+[.)]\s*"
NO_CONTEXT = "No relevant documentation found."

# ---- fixed values: keyword scoring --------------------------------------------------------
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

# ---- fixed values: HTML to text -----------------------------------------------------------
HTML_MARKUP = (
    r"(?is)<script\b[^>]*>(.*?)</script\s*>|<style\b[^>]*>(.*?)</style\s*>|<!--.*?-->|<[^>]*>"
)
HTML_SCRIPTS = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
HTML_ENTITIES = (
    ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&nbsp;", "\u00a0"), ("&lt;", "<"),
    ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
)
NO_BODY = "No body content"

# ---- reply templates: wording of our own, keyed by category, '' is the general one --------
TEMPLATES = {
    "technical_support": "Technical case from {sender}\nTopic: {subject}\nText: {body}\nKnown facts: {context}",
    "billing": "Billing case from {sender}\nTopic: {subject}\nText: {body}\nAccount facts: {context}",
    "feedback": "Feedback from {sender}\nTopic: {subject}\nText: {body}",
    "feature_request": "Wish from {sender}\nTopic: {subject}\nText: {body}",
    "": "Mail: {subject}\n{body}\nKnown facts: {context}",
}
SLOT_DEFAULTS = {
    "sender": "Valued Customer",
    "subject": "Your inquiry",
    "body": "",
    "context": "No further context is available.",
}
