"""Values that the SQL of the queries states for itself, so that a wrong value in the library shows as a difference."""

# English stop words, as SQL text.
STOPS_SQL = """('a', 'about', 'above', 'after', 'again', 'against', 'all', 'am', 'an', 'and', 'any', 'are', 'aren''t', 'as', 'at', 'be', 'because', 'been', 'before', 'being', 'below', 'between', 'both', 'but', 'by',
'can''t', 'cannot', 'could', 'couldn''t', 'did', 'didn''t', 'do', 'does', 'doesn''t', 'doing', 'don''t', 'down', 'during', 'each', 'few', 'for', 'from', 'further', 'had', 'hadn''t', 'has', 'hasn''t', 'have', 'haven''t', 'having',
'he', 'he''d', 'he''ll', 'he''s', 'her', 'here', 'here''s', 'hers', 'herself', 'him', 'himself', 'his', 'how', 'how''s', 'i', 'i''d', 'i''ll', 'i''m', 'i''ve', 'if', 'in', 'into', 'is', 'isn''t', 'it', 'it''s', 'its', 'itself',
'let''s', 'me', 'more', 'most', 'mustn''t', 'my', 'myself', 'no', 'nor', 'not', 'of', 'off', 'on', 'once', 'only', 'or', 'other', 'ought', 'our', 'ours', 'ourselves', 'out', 'over', 'own', 'same', 'shan''t', 'she', 'she''d',
'she''ll', 'she''s', 'should', 'shouldn''t', 'so', 'some', 'such', 'than', 'that', 'that''s', 'the', 'their', 'theirs', 'them', 'themselves', 'then', 'there', 'there''s', 'these', 'they', 'they''d', 'they''ll', 'they''re',
'they''ve', 'this', 'those', 'through', 'to', 'too', 'under', 'until', 'up', 'very', 'was', 'wasn''t', 'we', 'we''d', 'we''ll', 'we''re', 'we''ve', 'were', 'weren''t', 'what', 'what''s', 'when', 'when''s', 'where', 'where''s',
'which', 'while', 'who', 'who''s', 'whom', 'why', 'why''s', 'with', 'won''t', 'would', 'wouldn''t', 'you', 'you''d', 'you''ll', 'you''re', 'you''ve', 'your', 'yours', 'yourself', 'yourselves', 'will', 'shall', 'may', 'might', 'must', 'page')"""

# Clause markers as SQL patterns, with their category.
MARKERS_SQL = [
    (r"\b(must)\b", "obligation"), (r"\b(shall(?:\s+not)?)\b", "obligation"), (r"\b(agrees?\s+to|agreed\s+to)\b", "obligation"), (r"\b(is\s+required\s+to|are\s+required\s+to)\b", "obligation"),
    (r"\b(covenants?\s+that|undertakes?\s+to)\b", "obligation"), (r"\b(within\s+(?:\d+|[a-z]+)\s+(?:calendar\s+|business\s+)?(?:days|weeks|months))\b", "deadline"), (r"\b(no\s+later\s+than|due\s+on|on\s+or\s+before)\b", "deadline"),
    (r"\b(penalt(?:y|ies)|liquidated\s+damages|fine)\b", "penalty"), (r"\b(terminat(?:ion|e|ed|ing))\b", "penalty"), (r"\b(forfeit(?:ure)?|default|breach)\b", "penalty"),
    (r"\b(subject\s+to)\b", "right"), (r"\b(entitled\s+to|has\s+(?:the\s+)?right\s+to)\b", "right"), (r"\b(may\s+(?:at\s+its\s+discretion|elect\s+to)?|at\s+its\s+sole\s+discretion)\b", "right"),
]

# Terms and weights of the generic classes.
GENERIC_TERMS = {
    "Receipt": [("receipt", 30), ("cash receipt", 35), ("tax receipt", 35), ("subtotal", 20), ("tendered", 25), ("change due", 25), ("pos terminal", 25), ("cashier", 20), ("store #", 20), ("items purchased", 20), ("card txn", 20), ("register #", 20), ("merchant copy", 25), ("customer copy", 20), ("payment method", 15)],
    "Invoice": [("invoice", 30), ("tax invoice", 35), ("bill to", 25), ("billed to", 25), ("invoice date", 25), ("invoice no", 25), ("inv #", 25), ("due date", 20), ("po #", 20), ("purchase order", 25), ("gstin", 20), ("vat #", 20), ("terms: net", 25), ("amount due", 20), ("balance due", 20), ("remit to", 20), ("payment terms", 20), ("medical bill", 35), ("hospital bill", 35), ("patient name", 25), ("consultation fee", 25), ("pharmacy bill", 25)],
    "Utility Bill": [("utility bill", 35), ("electricity bill", 35), ("water bill", 35), ("gas bill", 35), ("telecom bill", 35), ("broadband bill", 35), ("meter reading", 30), ("units consumed", 30), ("kwh", 25), ("consumer number", 25), ("consumer id", 25), ("tariff", 20), ("billing cycle", 25), ("power distribution", 25), ("disconnection date", 25), ("previous reading", 20), ("current reading", 20)],
    "ID Document": [("identity card", 35), ("identification", 30), ("id card", 35), ("national id", 35), ("date of birth", 30), ("dob", 25), ("gender", 20), ("valid until", 25), ("expiry date", 25), ("nationality", 25), ("card number", 25), ("holder name", 25), ("blood group", 25), ("id number", 25), ("place of birth", 20)],
    "Certificate": [("certificate", 30), ("this is to certify", 35), ("certifies that", 35), ("awarded to", 35), ("completion", 20), ("achievement", 25), ("authorized signatory", 25), ("in witness whereof", 20), ("conferred upon", 35), ("diploma", 30), ("degree", 25), ("university degree", 35), ("bachelor of", 30), ("master of", 30), ("doctor of", 30), ("academic year", 25), ("certificate of merit", 35), ("in recognition of", 25)],
    "Official Letter": [("to whom it may concern", 35), ("dear sir", 25), ("dear madam", 25), ("formal request", 25), ("memorandum", 25), ("office memo", 30), ("yours faithfully", 30), ("letter of intent", 30), ("with reference to", 20), ("kindly request", 20), ("formal notice", 25), ("subject:", 15)],
    "Financial Statement": [("financial statement", 35), ("bank statement", 35), ("balance sheet", 35), ("income statement", 35), ("profit and loss", 35), ("cash flow", 30), ("opening balance", 30), ("closing balance", 30), ("credit", 15), ("debit", 15), ("ledger", 25), ("account statement", 35), ("transaction history", 30), ("assets and liabilities", 30)],
    "Notes": [("meeting notes", 35), ("minutes of meeting", 35), ("action items", 30), ("summary notes", 30), ("lecture notes", 35), ("brainstorming", 25), ("key takeaways", 30), ("memo notes", 30), ("discussion points", 25), ("attendees:", 25), ("notes:", 20)],
    "Contract": [("agreement", 25), ("contract", 25), ("terms and conditions", 25), ("memorandum of understanding", 35), ("non-disclosure agreement", 35), ("between the parties", 30), ("party of the first part", 35), ("party of the second part", 35), ("whereas", 25), ("covenant", 25), ("hereby agree", 30), ("governing law", 30), ("indemnification", 25), ("severability", 25), ("employment contract", 35), ("employment agreement", 35), ("employer", 25), ("employee", 25), ("remuneration", 25), ("job title", 20)],
}

# Terms and weights of the simple classes.
SIMPLE_CLASSES = {
    "RECEIPT": [("receipt", 20), ("cash receipt", 20), ("tax receipt", 20), ("pos terminal", 20), ("cashier", 20), ("store #", 20), ("item total", 20), ("subtotal", 20), ("tendered", 20), ("change due", 20), ("thank you", 20), ("card txn", 20), ("register #", 20)],
    "INVOICE": [("invoice", 20), ("invoice no", 20), ("inv #", 20), ("bill to", 20), ("billed to", 20), ("invoice date", 20), ("due date", 20), ("po number", 20), ("purchase order", 20), ("tax invoice", 20), ("gstin", 20), ("gst #", 20), ("vat no", 20), ("terms: net", 20), ("payment due", 20)],
    "UTILITY_BILL": [("utility bill", 20), ("electricity bill", 20), ("water bill", 20), ("meter reading", 20), ("units consumed", 20), ("consumer number", 20), ("consumer id", 20), ("tariff", 20), ("billing cycle", 20), ("telecom bill", 20), ("broadband bill", 20), ("gas bill", 20), ("kwh", 20), ("bill date", 20), ("due date", 20), ("disconnection", 20)],
    "ID_DOCUMENT": [("identity card", 20), ("identification", 20), ("id card", 20), ("date of birth", 20), ("dob", 20), ("gender", 20), ("valid until", 20), ("expiry date", 20), ("nationality", 20), ("card number", 20), ("holder name", 20), ("id number", 20), ("blood group", 20), ("issued on", 20)],
    "BANK_STATEMENT": [("bank statement", 20), ("account statement", 20), ("account number", 20), ("account holder", 20), ("opening balance", 20), ("closing balance", 20), ("deposit", 20), ("withdrawal", 20), ("statement period", 20), ("transaction date", 20), ("cheque", 20), ("branch code", 20), ("ifsc", 20), ("swift", 20), ("iban", 20), ("ledger", 20)],
}

# Subjects of tags, in order.
SUBJECT_TAGS = [
    ("electricity", "Electricity"), ("water", "Water"), ("gas", "Gas"), ("broadband", "Broadband"), ("telecom", "Telecom"), ("paid", "Paid"), ("unpaid", "Unpaid"), ("due", "Due"), ("pending", "Pending"), ("overdue", "Overdue"), ("confidential", "Confidential"), ("agreement", "Agreement"), ("tax", "Tax"), ("gst", "GST"), ("vat", "VAT"), ("audit", "Audit"), ("medical", "Medical"), ("travel", "Travel"), ("ticket", "Ticket"), ("flight", "Flight"), ("academic", "Academic"), ("salary", "Salary"), ("payroll", "Payroll"), ("subscription", "Subscription"), ("retail", "Retail"), ("hardware", "Hardware"), ("groceries", "Groceries"), ("meeting", "Meeting"), ("minutes", "Minutes"), ("statement", "Statement"), ("certificate", "Certificate"), ("identity", "Identity"), ("national", "National"), ("employment", "Employment"), ("contract", "Contract"), ("hospital", "Hospital"), ("patient", "Patient"), ("university", "University"), ("degree", "Degree"),
]

# Roman numerals.
NUMERALS = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]

# Syllables of irregular words.
IRREGULAR = {"queue": 1, "rhythm": 2, "rhythms": 2, "subtle": 2, "simile": 3, "recipe": 3, "create": 2, "created": 2, "creates": 2, "creative": 3, "creation": 3, "area": 3, "areas": 3, "idea": 3, "ideas": 3, "poem": 2, "poems": 2, "poetry": 3, "lion": 2, "lions": 2, "science": 2, "society": 4, "quiet": 2, "quietly": 3, "video": 3, "videos": 3, "radio": 3, "media": 3, "naive": 2, "oasis": 3, "syllable": 3, "syllables": 3, "business": 2, "people": 2, "separate": 3, "interesting": 4, "comfortable": 4, "temperature": 4}

# Abbreviations before a full stop.
ABBREVIATED = r"Mr|Mrs|Ms|Dr|Prof|Sr|Jr|vs|etc|e\.g|i\.e|Ltd|Inc|Corp|No|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"

# Blocks of the script families, in order.
SCRIPT_BLOCKS = {
    "devanagari": r"[\x{900}-\x{97f}]",
    "bengali": r"[\x{980}-\x{9ff}]",
    "gurmukhi": r"[\x{a00}-\x{a7f}]",
    "gujarati": r"[\x{a80}-\x{aff}]",
    "odia": r"[\x{b00}-\x{b7f}]",
    "tamil": r"[\x{b80}-\x{bff}]",
    "telugu": r"[\x{c00}-\x{c7f}]",
    "kannada": r"[\x{c80}-\x{cff}]",
    "malayalam": r"[\x{d00}-\x{d7f}]",
    "arabic": r"[\x{600}-\x{6ff}\x{750}-\x{77f}\x{8a0}-\x{8ff}\x{fb50}-\x{fdff}\x{fe70}-\x{feff}]",
    "latin": r"[\x{41}-\x{5a}\x{61}-\x{7a}\x{c0}-\x{24f}]",
    "han": r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]",
}

# Patterns of personal data, as SQL reads them.
PRESET_PATTERNS = {
    "email": r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b",
    "phone": r"(?:\+91[\-\s]?)?[6-9]\d{4}[\-\s]?\d{5}\b|(?:\+91[\-\s]?)?[6-9]\d{9}\b|(?:\+?1[\-\s]?)?\(?\d{3}\)?[\-\s]?\d{3}[\-\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b\d{13,19}\b",
    "national_id": r"\b[2-9]\d{3}[\s\-]?[0-9]{4}[\s\-]?[0-9]{4}\b",
    "tax_id": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "date": r"(?i)\b\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}\b|\b\d{4}[-\/]\d{2}[-\/]\d{2}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b",
}

# Stop words of tags, as SQL text.
TAG_STOPS_SQL = """('a', 'about', 'above', 'after', 'again', 'against', 'all', 'am', 'an', 'and', 'any', 'are', 'aren''t', 'as', 'at', 'be', 'because', 'been', 'before', 'being', 'below', 'between', 'both', 'but', 'by',
'can', 'can''t', 'cannot', 'could', 'couldn''t', 'did', 'didn''t', 'do', 'does', 'doesn''t', 'doing', 'don''t', 'down', 'during', 'each', 'few', 'for', 'from', 'further', 'had', 'hadn''t', 'has', 'hasn''t',
'have', 'haven''t', 'having', 'he', 'he''d', 'he''ll', 'he''s', 'her', 'here', 'here''s', 'hers', 'herself', 'him', 'himself', 'his', 'how', 'how''s', 'i', 'i''d', 'i''ll', 'i''m', 'i''ve', 'if', 'in', 'into', 'is',
'isn''t', 'it', 'it''s', 'its', 'itself', 'let''s', 'me', 'more', 'most', 'mustn''t', 'my', 'myself', 'no', 'nor', 'not', 'of', 'off', 'on', 'once', 'only', 'or', 'other', 'ought', 'our', 'ours', 'ourselves',
'out', 'over', 'own', 'same', 'shan''t', 'she', 'she''d', 'she''ll', 'she''s', 'should', 'shouldn''t', 'so', 'some', 'such', 'than', 'that', 'that''s', 'the', 'their', 'theirs', 'them', 'themselves',
'then', 'there', 'there''s', 'these', 'they', 'they''d', 'they''ll', 'they''re', 'they''ve', 'this', 'those', 'through', 'to', 'too', 'under', 'until', 'up', 'very', 'was', 'wasn''t', 'we', 'we''d',
'we''ll', 'we''re', 'we''ve', 'were', 'weren''t', 'what', 'what''s', 'when', 'when''s', 'where', 'where''s', 'which', 'while', 'who', 'who''s', 'whom', 'why', 'why''s', 'with', 'won''t', 'would',
'wouldn''t', 'you', 'you''d', 'you''ll', 'you''re', 'you''ve', 'your', 'yours', 'yourself', 'yourselves', 'page', 'document', 'total', 'number', 'date', 'details', 'please', 'thank',
'thanks', 'regards', 'sincerely', 'www', 'com', 'org', 'http', 'https', 'email', 'phone', 'tel', 'fax', 'null', 'undefined', 'pdf', 'scanned', 'scan', 'copy', 'file', 'item', 'items')"""
