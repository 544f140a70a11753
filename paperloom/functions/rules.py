"""Vocabularies, patterns and constants of document analysis.

Fixed values: they decide results, so they are given as they must be. The code
elsewhere only folds over them.
"""

from __future__ import annotations

# Document types in order of precedence, with required words (2 points each, one at least) and optional ones (1 point each).
DOCUMENT_TYPES = {
    "INVOICE": (
        ("invoice",),
        ("customer id", "order id", "total", "unit price", "totalprice", "product name", "subtotal", "due date", "amount due", "bill to"),
    ),
    "PURCHASE_ORDER": (
        ("purchase order",),
        ("order id", "order date", "unit price", "quantity", "product", "vendor", "ship to", "po number", "delivery"),
    ),
    "RECEIPT": (("receipt",), ("total", "tax", "cash", "transaction", "cashier", "change", "thank you", "store")),
    "CONTRACT": (
        ("agreement", "contract"),
        ("party", "whereas", "obligations", "termination", "governing law", "effective date", "signed", "clause", "hereinafter"),
    ),
    "RESUME": (
        ("resume", "curriculum vitae"),
        ("experience", "education", "skills", "employment", "objective", "references", "linkedin"),
    ),
    "EMAIL": (("from:", "to:", "subject:"), ("cc:", "bcc:", "sent:", "dear", "regards", "sincerely", "forwarded")),
    "BANK_STATEMENT": (
        ("statement", "account number"),
        ("balance", "debit", "credit", "opening balance", "closing balance", "iban", "routing", "sort code"),
    ),
    "REPORT": (
        ("report", "summary", "analysis", "findings"),
        ("executive summary", "conclusion", "methodology", "recommendation", "table of contents", "appendix"),
    ),
    "FORM": (("form", "please fill", "signature"), ("date of birth", "full name", "applicant", "submit", "checkbox", "tick")),
    "MEDICAL_RECORD": (
        ("patient", "diagnosis"),
        ("prescription", "medication", "doctor", "hospital", "symptoms", "treatment", "blood pressure", "icd"),
    ),
}
TRADE_TYPES = ("INVOICE", "PURCHASE_ORDER", "RECEIPT")
KNOWN_CONFIDENCE, HEURISTIC_CAP = 0.4, 0.39
CURRENCY_BOOST, TABLE_BOOST, PROSE_BOOST, COLON_BOOST = 0.15, 0.10, 0.10, 0.10
PROSE_LINE, NARRATIVE_LINE, COLON_RATIO = 60, 70, 1.5

# Patterns of layout, key/value pairs and typed entities.
CURRENCY = r"[$€£₹¥₩]"
DATE_ISO = r"\b\d{4}-\d{2}-\d{2}\b"
DATE_DMY = r"\b\d{2}/\d{2}/\d{4}\b"
NUMBERED_LINE = r"(?m)^\s*\d+[\.\)]\s+\w"
BULLET_LINE = r"(?m)^\s*[•\-\*]\s+\w"
CAPITALS_LINE = r"(?m)^[A-Z][A-Z\s]{5,}$"
MONEY = r"([$€£₹¥₩])\s*(\d[\d,]*(?:\.\d{1,2})?)"
KEY_VALUE = r"([A-Z][A-Za-z0-9 /\-_]{1,50}?)\s*[:\-–]\s*([^\n]{1,200})"
ENTITIES = {
    "dates": (r"(?i)\b(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{2,4})\b", 1, 10),
    "amounts": (r"(?i)(?:[\$€£₹¥₩])\s?\d[\d,]*(?:\.\d{1,2})?|\d[\d,]*(?:\.\d{1,2})?\s?(?:USD|EUR|GBP|INR|JPY|AUD|CAD)\b", 0, 10),
    "phone_numbers": (r"\(?\+?[\d\s\-\(\)]{7,20}\d", 0, 5),
    "email_addresses": (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", 0, 5),
    "order_ids": (r"(?i)(?:order\s*(?:id|#|no\.?|number)\s*[:\-]?\s*)([A-Z0-9\-]{3,30})", 1, 10),
    "invoice_ids": (r"(?i)(?:invoice\s*(?:id|#|no\.?|number)\s*[:\-]?\s*)([A-Z0-9\-]{3,30})", 1, 10),
    "totals": (r"(?i)(?:total\s*price|totalprice|grand\s*total|amount\s*due|net\s*total|subtotal|balance\s*due)[\s:]*([\$€£₹¥]?\s?\d[\d,]*(?:\.\d{1,2})?)", 1, 10),
    "postal_codes": (r"\b(?:[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}|\d{5}(?:-\d{4})?|[A-Z]\d[A-Z]\s?\d[A-Z]\d|\d{4,6})\b", 0, 10),
}
PAIR_CAP = 200

# Fields of the trade types, with the labels that may precede them in order of preference.
TYPED_FIELDS = {
    "INVOICE": {
        "invoice_id": ("invoice id", "invoice no", "invoice number", "invoice #"),
        "order_id": ("order id", "order no", "order #", "order number"),
        "customer_id": ("customer id", "customer no", "client id"),
        "date": ("order date", "invoice date", "date"),
        "due_date": ("due date", "payment due"),
        "total_amount": ("total price", "totalprice", "grand total", "amount due", "total"),
        "customer_name": ("contact name", "customer name", "billed to", "bill to"),
    },
    "PURCHASE_ORDER": {
        "order_id": ("order id", "po number", "po #", "order no"),
        "date": ("order date", "date"),
        "customer_name": ("customer name", "buyer", "ship to"),
        "vendor_name": ("vendor", "supplier", "seller"),
    },
    "RECEIPT": {
        "receipt_id": ("receipt no", "transaction id", "ref"),
        "date": ("date", "transaction date"),
        "total_amount": ("total", "amount", "grand total"),
    },
}
FIELD_VALUE = r"\s*[:\-–]\s*([^\n]{1,100})"

# Fields that key/value pairs and tables may still fill, and their labels there.
ENRICHED_FIELDS = {
    "order_id": ("order id", "order no", "order number", "po number", "po #"),
    "customer_name": ("customer name", "billed to", "bill to", "buyer", "ship to"),
    "date": ("date", "order date", "invoice date", "transaction date"),
    "customer_id": ("customer id", "customer no", "client id"),
    "total_amount": ("total", "total price", "totalprice", "amount due", "grand total", "net total", "subtotal", "balance due"),
    "country": ("country",),
    "city": ("city",),
    "contact_name": ("contact name",),
}

# Tables.
KEY_CELL = r"^[A-Za-z][A-Za-z0-9 _\-/\.]{1,40}$"
HEADER_CELL = r"^[A-Za-z][A-Za-z0-9 _\-/\.%#]{0,40}$"
NUMBER_CELL = r"^\s*[\d.,]+\s*$"
FOOTER_LABELS = ("totalprice", "total price", "grand total", "subtotal", "amount due", "net total", "balance due")
KEY_TABLE_SHARE, HEADER_SHARE, HEADER_ROWS = 0.7, 0.6, 4
FUZZY_THRESHOLD, FUZZY_BONUS = 0.6, 0.9
TABLE_ROWS = 50
# Labels of the columns with a table's products, in order of preference, and how many a header shows.
PRODUCT_LABELS = ("product name", "product", "description")
QUANTITY_LABELS = ("quantity", "qty")
HEADER_PRODUCTS = 10

# Line items.
ITEM_LABELS = r"(?i)(Product:|Quantity:|Unit\s*Price:|Total:)"
PRODUCT_LABEL = r"(?i)\bProduct\s*:"
TOTAL_TOLERANCE = 0.01

# Domains in order, with their words.
DOMAINS = {
    "Finance": ("invoice", "payment", "receipt", "tax", "gst", "amount", "balance", "credit", "debit", "bank", "account", "transaction", "upi", "total", "revenue", "expense", "profit", "loss", "budget", "salary", "payroll", "refund", "billing", "ledger", "audit"),
    "Legal": ("contract", "agreement", "clause", "penalty", "liability", "terms and conditions", "indemnity", "arbitration", "jurisdiction", "warranty", "confidential", "non-disclosure", "nda", "compliance", "regulation", "statute", "court", "legal", "attorney", "law"),
    "Medical": ("patient", "diagnosis", "prescription", "hospital", "doctor", "medical", "health", "clinical", "treatment", "pharmacy", "lab report", "blood", "test result", "symptom", "disease"),
    "HR": ("employee", "resume", "cv", "hire", "onboarding", "leave", "attendance", "appraisal", "performance review", "designation", "department", "human resource", "training", "offer letter"),
    "Operations": ("shipment", "delivery", "logistics", "warehouse", "inventory", "supply chain", "purchase order", "vendor", "procurement", "shipping", "tracking", "dispatch"),
}
STRONG_DOMAIN = 3
# Risk words, amounts and vendors.
HIGH_RISK = ("penalty", "liability", "termination", "breach", "dispute", "overdue", "default", "fraud", "violation", "critical", "urgent", "lawsuit", "damages", "forfeiture")
MEDIUM_RISK = ("warning", "caution", "review", "amendment", "exception", "delay", "escalation", "discrepancy", "pending")
AMOUNT_BUCKETS = ((1_000, "Under1K"), (5_000, "1K-5K"), (50_000, "5K-50K"), (None, "Over50K"))
HIGH_AMOUNT = 50_000
VENDOR_PATTERNS = (
    r"(?:vendor|supplier|company|firm|seller|merchant)[\s]*(?:name)?[\s]*[:\-]\s*(.+)",
    r"(?:bill\s*from|from|sold\s*by|issued\s*by)[\s]*[:\-]\s*(.+)",
)
DEFAULT_STATUS = "Status:Under Review"
RISK_TYPES = ("contract", "legal", "agreement", "nda")
RISK_TAGS = ("Risk:High", "Risk:Medium")

# Chunks, retrieval and memory.
WHOLE_PAGE, WINDOW, OVERLAP = 800, 400, 80
SENTENCE_ENDS = (". ", ".\n", "\n\n")
EMBED_SIZE, EMBED_OVERLAP = 500, 50
TOP_K, MAX_K, POOL, BALANCE, EXCHANGES = 5, 50, 4, 0.5, 10
PREVIEW, STORED_CHUNK = 200, 500
UPLOAD_TYPES = ("pdf", "png", "jpg", "jpeg")
