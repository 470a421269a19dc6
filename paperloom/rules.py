"""Domain values of the document platform, kept as plain data.

Everything in this module is a FIXED VALUE: word lists, lookup tables, thresholds and patterns that
have to be exactly these for results to agree. Operators read them; no logic lives here.
"""

# --- document categories and fact keys (fixed values) -------------------------------------------
CATEGORIES = [
    "contract",
    "electricity_bill",
    "water_bill",
    "invoice",
    "receipt",
    "salary_slip",
    "bank_statement",
    "credit_card_statement",
    "insurance",
    "warranty",
    "official_letter",
    "recipe",
    "other",
]

FACT_KEYS = [
    "source_date",
    "counterparty",
    "amount",
    "currency",
    "document_reference",
    "period_start",
    "period_end",
    "policy_number",
    "contract_end_date",
    "recipe_name",
    "ingredients",
    "instructions",
    "servings",
    "prep_time",
    "contract_type",
    "parties",
    "obligations",
    "renewal_terms",
    "penalty_clause",
    "governing_law",
    "termination_clause",
    "insurance_type",
    "coverage_description",
    "premium_amount",
    "deductible_amount",
    "insured_name",
    "beneficiary",
    "coverage_limit",
]

EXCERPT_CAP = 250
REVIEW_CONFIDENCE = 0.5
PROMOTE_CONFIDENCE = 0.6
SALARY_PROMOTE_CONFIDENCE = 0.8
CLASSIFIER_ACCEPT = 0.6
FILENAME_CONFIDENCE = 0.9
TEXT_CONFIDENCE = 0.8

# Ordered: the first rule with a hit decides (fixed values).
KEYWORD_RULES = [
    ("electricity_bill", ["אלקטרה פאוור", "electra power", "מספר צרכן אלקטרה", "צריכה מאלקטרה", "עם חשמל ירוק"]),
    ("water_bill", ["מי רעננה", "שירותי מים וביוב", "כמות המים לחיוב", "צריכת מים", "מד מים"]),
    ("invoice", ["invoice", "חשבונית", "tax invoice", "vat invoice"]),
    ("receipt", ["receipt", "קבלה", "קבלה על תשלום"]),
    ("salary_slip", ["תלוש שכר", "תלוש משכורת", "ברוטו", "נטו", "מס הכנסה", "salary slip", "payslip", "pay stub"]),
    ("contract", ["contract", "חוזה", "הסכם", "agreement", "עסקה"]),
    ("bank_statement", ["bank statement", "דף חשבון", "account statement", "תנועות בחשבון"]),
    ("credit_card_statement", ["credit card", "כרטיס אשראי", "card statement", "חיובי כרטיס"]),
    ("insurance", ["insurance", "ביטוח", "פוליסה", "policy", "insured"]),
    ("warranty", ["warranty", "אחריות", "guarantee", "תעודת אחריות"]),
    ("official_letter", ["official", "רשמי", "עירייה", "משרד", "municipality", "government", "ministry"]),
    (
        "recipe",
        ["מתכון", "מצרכים", "אופן הכנה", "הוראות הכנה", "recipe", "ingredients", "instructions", "כוסות", "כפות", "גרם"],
    ),
]

# Fact keys a category is searched for (fixed values).
CATEGORY_FACT_KEYS = {
    "electricity_bill": ["source_date", "counterparty", "amount", "currency", "document_reference", "period_start", "period_end"],
    "water_bill": ["source_date", "counterparty", "amount", "currency", "document_reference", "period_start", "period_end"],
    "invoice": ["source_date", "counterparty", "amount", "currency", "document_reference"],
    "receipt": ["source_date", "counterparty", "amount", "currency"],
    "contract": [
        "source_date", "counterparty", "contract_end_date", "document_reference", "contract_type", "parties",
        "obligations", "renewal_terms", "penalty_clause", "governing_law", "termination_clause", "amount",
        "currency", "period_start", "period_end",
    ],
    "bank_statement": ["source_date", "counterparty", "period_start", "period_end"],
    "credit_card_statement": ["source_date", "counterparty", "amount", "currency", "period_start", "period_end"],
    "insurance": [
        "source_date", "counterparty", "policy_number", "period_start", "period_end", "insurance_type",
        "coverage_description", "premium_amount", "deductible_amount", "insured_name", "beneficiary",
        "coverage_limit", "amount", "currency",
    ],
    "warranty": ["source_date", "counterparty", "period_end"],
    "official_letter": ["source_date", "counterparty", "document_reference"],
    "other": ["source_date", "counterparty", "amount", "currency"],
    "recipe": ["recipe_name", "ingredients", "instructions", "servings", "prep_time"],
    "salary_slip": ["source_date", "counterparty", "amount", "currency"],
}

MULTI_VALUE_KEYS = [
    "obligations", "parties", "coverage_description", "penalty_clause", "renewal_terms", "termination_clause",
]

RECIPE_KEYS = ["recipe_name", "ingredients", "instructions", "servings", "prep_time"]
RECIPE_CONFIDENCE = {"recipe_name": 0.7, "ingredients": 0.7, "instructions": 0.7, "servings": 0.6, "prep_time": 0.6}

# fact key -> document column (fixed values)
PROMOTION_MAP = {"counterparty": "vendor", "amount": "amount", "currency": "currency", "source_date": "doc_date"}

# --- text, dates, money (fixed values) ----------------------------------------------------------
HEBREW_MONTHS = [
    "ינואר", "פברואר", "מרץ", "אפריל", "מאי", "יוני", "יולי", "אוגוסט", "ספטמבר", "אוקטובר", "נובמבר", "דצמבר",
]
# Monday first
HEBREW_WEEKDAYS = ["שני", "שלישי", "רביעי", "חמישי", "שישי", "שבת", "ראשון"]
DISPLAY_TIME_ZONE = "Asia/Jerusalem"

# Ordered by priority, not by position in the text. The first group is the value.
DATE_PATTERNS = [
    r"\b(\d{1,2}[./]\d{1,2}[./]\d{2,4})\b",
    r"\b(\d{4}-\d{2}-\d{2})\b",
    r"\b(\d{1,2}\s+(?:ינואר|פברואר|מרץ|אפריל|מאי|יוני|יולי|אוגוסט|ספטמבר|אוקטובר|נובמבר|דצמבר)\s+\d{4})\b",
]
DATE_CONFIDENCE = 0.75
DATE_EXCERPT_MARGIN = 30

AMOUNT_PATTERN = (
    r"(?:NIS|ILS|₪|\$|€|USD|EUR)\s*([\d,]+(?:\.\d{1,2})?)"
    r"|([\d,]+(?:\.\d{1,2})?)\s*(?:NIS|ILS|₪|\$|€|USD|EUR|ש\"ח|שקל)"
)
AMOUNT_START = r"(?=[₪$€0-9,]|N[Iİı]|[Iİı]L|US|EU)"  # every match of AMOUNT_PATTERN begins with one of these, in any case
AMOUNT_CONFIDENCE = 0.8
AMOUNT_EXCERPT_MARGIN = 20
CURRENCY_MARGIN = 5
# Ordered and case-sensitive.
CURRENCY_SYMBOLS = [
    ("₪", "ILS"), ('ש"ח', "ILS"), ("שקל", "ILS"), ("NIS", "ILS"), ("ILS", "ILS"),
    ("$", "USD"), ("USD", "USD"), ("€", "EUR"), ("EUR", "EUR"),
]
DEFAULT_CURRENCY = "ILS"

LARGE_TEXT_CHARS = 4000
CHUNK_CHARS = 3000
CHUNK_OVERLAP = 300
MIN_TEXT_QUALITY = 0.3

HEBREW_RATIO_TIERS = [(0.4, 1.0), (0.2, 0.6), (0.05, 0.3)]
HEBREW_RATIO_FLOOR = 0.1
NEUTRAL_LANG_SCORE = 0.5
WORD_LENGTH_TIERS = [(2.5, 10, 1.0), (1.5, 15, 0.5)]
WORD_LENGTH_FLOOR = 0.1
CONSONANT_RUN = r"(?i)[bcdfghjklmnpqrstvwxyz]{5,}"
CONSONANT_TIERS = [(0.05, 1.0), (0.15, 0.5)]
CONSONANT_FLOOR = 0.1
QUALITY_WEIGHTS = [0.4, 0.2, 0.25, 0.15]
GOOD_QUALITY = 0.5
BORDERLINE_QUALITY = 0.3

# --- personal data masks (fixed values; ordered) ------------------------------------------------
# (pattern, placeholder label, type)
PII_PATTERNS = [
    (r"\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{1,7}", "כרטיס", "credit_card"),
    (r"(?:\+?972)[2-9]\d{7,8}", "טלפון", "phone"),
    (r"0[2-9]\d{7,8}", "טלפון", "phone"),
    (r"[\w.-]+@[\w.-]+\.\w{2,}", "אימייל", "email"),
    (r"\d{2,3}[-/]\d{6,9}", "חשבון בנק", "bank_account"),
    (r"\b\d{9}\b", "ת.ז.", "israeli_id"),
]
AUDIT_TEXT_CAP = 200
PII_SUFFIX = "[PII removed]"

# --- files and extractors (fixed values) --------------------------------------------------------
EXTRACTABLE_EXTENSIONS = [".pdf", ".doc", ".docx", ".jpg", ".jpeg", ".png", ".heic"]
SPREADSHEET_EXTENSIONS = [".xls", ".xlsx"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".heic", ".tiff", ".bmp"]
# (byte offset from 1, bytes in hex, extension); ordered
MAGIC_BYTES = [
    (1, "FFD8FF", ".jpg"),
    (1, "89504E470D0A1A0A", ".png"),
    (1, "25504446", ".pdf"),
    (1, "424D", ".bmp"),
    (1, "49492A00", ".tiff"),
    (1, "4D4D002A", ".tiff"),
    (5, "66747970", ".heic"),
]
UUID_PREFIX = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}_"

STRUCTURED_DOC_TYPES = [
    "salary_slip", "invoice", "receipt", "bank_statement", "credit_card_statement", "electricity_bill",
    "contract", "insurance",
]
STRUCTURED_FILENAME_HINTS = [
    "payslip", "pay_slip", "salary", "תלוש", "invoice", "חשבונית", "receipt", "קבלה", "bank_statement", "דף_חשבון",
    "contract", "חוזה", "הסכם", "insurance", "ביטוח", "פוליסה", "policy",
]
ROUTE_STRUCTURED = ["google_docai", "bedrock_vision", "tesseract"]
ROUTE_PDF = ["google_docai", "tesseract", "bedrock_vision"]
ROUTE_DEFAULT = ["tesseract", "bedrock_vision", "google_docai"]
EXTRACTOR_ACCEPT = 0.4
PAGES_PER_BATCH = 15
ALWAYS_GOOD_METHOD = "google_docai"

# --- known issuers (fixed values; ordered) ------------------------------------------------------
ISSUERS = [
    {
        "name": "electra_utility_bill",
        "doc_type": "electricity_bill",
        "record_type": "utility_bill",
        "routing_key": "utility_bill:electricity:electra_power",
        "provider_slug": "electra_power",
        "provider_name": "אלקטרה פאוור",
        "service_type": "electricity",
        "markers": ["מספר צרכן אלקטרה", "צריכה מאלקטרה", "עם חשמל ירוק", "super-power.co.il", "אלקטרה פאוור"],
    },
    {
        "name": "mei_raanana_water_bill",
        "doc_type": "water_bill",
        "record_type": "utility_bill",
        "routing_key": "utility_bill:water:mei_raanana",
        "provider_slug": "mei_raanana",
        "provider_name": "מי רעננה",
        "service_type": "water",
        "markers": ["מי רעננה", "שירותי מים וביוב", "כמות המים לחיוב", "מספר משלם"],
    },
]
ISSUER_CONFIDENCE = 0.95

ELECTRICITY_FIELDS = {
    "issuer_account_number": [r"מספר\s+צרכן\s+אלקטרה(?:\s+פאוור)?\s*[:：]?\s*(\d{5,})"],
    "issuer_bill_number": [
        r"חשבונית\s+מס/?קבלה\s*\(?.{0,20}?\)?\s*(\d{5,})",
        r"חשבונית\s+מס/?קבלה.*?(\d{5,})",
    ],
    "issuer_issue_date": [r"תאריך\s+עריכת\s+הח(?:ש|ע)בון\s*[:：]?\s*(\d{2}[./]\d{2}[./]\d{4})"],
}
# first date is the period END, second the START
ELECTRICITY_PERIOD = r"(\d{2}[./]\d{2}[./]\d{4})\s+(\d{2}[./]\d{2}[./]\d{4})"

WATER_FIELDS = {
    "issuer_account_number": [r"מספר\s+משלם\s*[:：]?\s*(\d{5,})"],
    "issuer_bill_number": [r"מספר\s+הספח/חשבונית\s+(\d+)", r"חשבונית\s*\n?\s*(\d{5,})"],
    "issuer_issue_date": [r"תאריך\s+הוצאת\s+החשבון\s+(\d{2}/\d{2}/\d{4})"],
    "water_consumption_m3": [r"כמות\s+המים\s+לחיוב\s*\n?\s*(\d+\.?\d*)\s*מ\"ק"],
    "private_consumption_m3": [r"סה\"כ\s+צריכה\s+פרטית\s+(\d+\.?\d*)"],
    "shared_consumption_m3": [r"צריכה\s+משותפת\s*\n?\s*(\d+\.?\d*)"],
    "household_size": [r"מספר\s+נפשות\s+מוכר\s+(\d+)"],
    "property_id": [r"מספר\s+הנכס\s*\n?\s*.*?\n?\s*(\d{5,})"],
    "property_address": [r"כתובת\s+הנכס\s*[:：]?\s*(.+?)(?:\n|$)"],
    "meter_number_private": [r"מד\s+מים\s+פרטי\s*\n?\s*.*?(\d{8,})"],
    "payment_due_date": [r"תאריך\s+אחרון\s+לתשלום\s*\n?\s*(\d{2}/\d{2}/\d{4})"],
    "payment_method": [r"(הוראת\s+קבע\s+באשראי.*?\d{4})"],
    "median_comparison_pct": [r"מהווה\s+(\d+\.?\d*)%"],
    "property_type": [r"סוג\s+שימוש\s*\n?\s*(.+?)(?:\n|$)"],
}
# start first, end second
WATER_PERIOD = r"(\d{2}/\d{2}/\d{4})\s*-\s*(\d{2}/\d{2}/\d{4})"

UTILITY_ACCOUNT_PATTERNS = [
    r"מספר\s+צרכן\s+אלקטרה(?:\s+פאוור)?\s*[:：]?\s*(\d{5,})",
    r"consumer\s+number\s*[:：]?\s*(\d{5,})",
]
UTILITY_BILL_PATTERNS = [
    r"חשבונית\s+מס/?קבלה\s*\(?.{0,20}?\)?\s*(\d{5,})",
    r"חשבונית\s+מס/?קבלה.*?(\d{5,})",
    r"\b(\d{5,})\b",
]
UTILITY_ISSUE_DATE_PATTERNS = [
    r"תאריך\s+עריכת\s+הח(?:ש|ע)בון\s*[:：]?\s*(\d{2}[./]\d{2}[./]\d{4})",
    r"issue\s+date\s*[:：]?\s*(\d{2}[./]\d{2}[./]\d{4})",
]
# column -> (kind, patterns)
UTILITY_EXTENDED = {
    "total_with_vat": ("money", [r"סה\"כ\s+כולל\s+מע\"מ.*?([\d,]+\.\d{2})"]),
    "vat_amount": ("money", [r"סה\"כ\s+מע\"מ\s*([\d,]+\.\d{2})"]),
    "consumption_kwh": (
        "quantity",
        [r"סה\"כ\s+צריכה.*?([\d,]+)\s*(?:בקוט|קוט)", r"סה\"כ\s+צריכה\s*\n\s*.*?\n\s*([\d,]+)"],
    ),
    "payment_due_date": ("date", [r"מועד\s+התשלום\s+בתאריך\s+(\d{2}/\d{2}/\d{4})"]),
    "payment_method": ("text", [r"יחויב\s+ב(כרטיס\s+אשראי\s+שמסתיים\s+בספרות\s+\d+)"]),
    "meter_number": ("text", [r"קריאות\s+מונה\s+מספר[:\s]*\n?.*?(\d{8,})"]),
    "tariff_plan": ("text", [r"מסלול\s+התחשבנות[:\s]*\n?\s*(.+?)(?:\n|$)"]),
    "contract_number": ("text", [r"מספר\s+חשבון\s+חוזה\s*\n?\s*(\d+)"]),
    "fixed_charges": ("money", [r"סה\"כ\s+תשלומים\s+קבועים.*?([\d,]+\.\d{2})"]),
    "kva_charge": ("money", [r"תשלום\s+בגין\s+הספק.*?([\d,]+\.\d{2})"]),
    "savings_this_bill": ("money", [r"בחשבון\s+זה\s+חסכת\s+([\d,]+\.\d{2})"]),
    "savings_cumulative": ("money", [r"ועד\s+היום\s+([\d,]+\.\d{2})"]),
    "service_address": (
        "text",
        [
            r"לכבוד\s*\n\s*.*?\n\s*(.+?)\n\s*(?:רעננה|תל אביב|ירושלים|חיפה|באר שבע|נתניה|הרצליה|ראשון|פתח|חולון|בת ים|אשדוד|אשקלון|כפר)"
        ],
    ),
}

# --- salary slips (fixed values) ----------------------------------------------------------------
SALARY_TEXT_KEYS = ["employee_name", "employer_name", "pay_month"]
SALARY_MONEY_KEYS = [
    "gross_salary", "net_salary", "net_to_pay", "total_deductions", "income_tax", "national_insurance",
    "health_tax", "pension_employee", "pension_employer",
]
SALARY_KEYS = SALARY_TEXT_KEYS + SALARY_MONEY_KEYS
SALARY_CRITICAL_KEYS = ["pay_month", "gross_salary", "net_salary"]
SALARY_STRONG_CONFIDENCE = 0.6
SALARY_PASS_LABELS = ["haiku_text", "sonnet_text"]
SALARY_EXTENDED = {
    "employee_id": ("text", [r"מספר\s+זהות\s*\n?\s*(\d{5,9})", r"ת\.?ז\.?\s*[:：]?\s*(\d{5,9})"]),
    "employer_id": ("text", [r"חברה\s*[:：]?\s*(\d{5,9})"]),
    "tax_file_number": ("text", [r"תיק\s+ניכויים\s*[:：]?\s*(\d{5,12})"]),
    "department": ("text", [r"מחלקה\s*[:：]?\s*(\d+)"]),
    "job_start_date": ("date", [r"התחלת\s+עבודה\s*\n?\s*(\d{2}/\d{2}/\d{4})"]),
    "job_percentage": ("money", [r"אחוז\s+משרה\s*\n?\s*(\d+(?:\.\d+)?)%?"]),
    "bank_account": ("text", [r"מספר\s+חשבון\s*\n?\s*.*?\n?\s*.*?\n?\s*(\d{6,12})"]),
    "bank_branch": ("text", [r"סניף\s*\n?\s*.*?\n?\s*(\d{1,4})\s*\n"]),
    "bank_code": ("text", [r"בנק\s*\n?\s*.*?\n?\s*.*?\n?\s*(\d{1,3})\s*\n"]),
    "tax_bracket_percent": ("money", [r"אחוז\s+מס\s+שולי\s*\n?\s*(\d+)%?"]),
    "tax_credit_points": ("money", [r"נקודות\s+זיכוי\s*\n?\s*(\d+(?:\.\d+)?)"]),
    "gross_for_tax": ("money", [r"ברוטו\s+למס\s+הכנסה\s+([\d,]+)"]),
    "gross_for_national_insurance": ("money", [r"ברוטו\s+לב\.?\s*לאומי\s+([\d,]+)"]),
    "marital_status": ("text", [r"מצב\s+משפחתי\s*\n?\s*.*?\n?\s*(נשוי|רווק|גרוש|אלמן)"]),
    "health_fund": ("text", [r"קופת[\s-]*חולים\s*\n?\s*.*?\n?\s*(מכבי|כללית|מאוחדת|לאומית)"]),
    "pension_fund_name": ("text", [r"(הפניקס|מגדל|הראל|מנורה|כלל|אלטשולר|מיטב)\s*(?:פנסיה|ביטוח)"]),
    "education_fund_name": (
        "text",
        [r"(אנליסט|הפניקס|מגדל|הראל|מנורה|כלל|אלטשולר|מיטב)\s*(?:השתלמות|קרן\s+השתלמות)"],
    ),
}
# follows the employee name and house number; the town list closes the address line
EMPLOYEE_ADDRESS_TAIL = (
    r"\s+\d+\s*.*?\n\s*(.+?)\n\s*(?:כפר|רעננה|תל אביב|ירושלים|חיפה|נתניה|הרצליה|ראשון|פתח|חולון|אשדוד)"
)

# --- display names (fixed values); salary_slip has no label and is shown like "other" -----------
DOC_TYPE_LABELS = {
    "contract": "חוזה",
    "electricity_bill": "חשבון חשמל",
    "water_bill": "חשבון מים",
    "invoice": "חשבונית",
    "receipt": "קבלה",
    "bank_statement": "דף חשבון",
    "credit_card_statement": "כרטיס אשראי",
    "insurance": "ביטוח",
    "warranty": "אחריות",
    "official_letter": "מכתב רשמי",
    "recipe": "מתכון",
    "other": "מסמך",
}
GENERIC_LABEL = "מסמך"
AUTO_TAG_FACT_TYPES = ["policy", "contract", "invoice", "payment"]

# --- questions and views over the catalog (fixed values; ordered) -------------------------------
QUESTION_FIELDS = [
    ("סוג", "doc_type"), ("type", "doc_type"), ("what type", "doc_type"), ("מה סוג", "doc_type"),
    ("סכום", "amount"), ("amount", "amount"), ("כמה", "amount"), ("עולה", "amount"), ("לתשלום", "amount"),
    ("כמה לתשלום", "amount"), ("כמה עלה", "amount"),
    ("ספק", "vendor"), ("vendor", "vendor"), ("counterparty", "vendor"), ("מי", "vendor"), ("מי הספק", "vendor"),
    ("תאריך", "doc_date"), ("date", "doc_date"), ("מתי", "doc_date"),
    ("תאריך התחלה", "period_start"), ("תאריך סיום", "period_end"),
    ("סיכום", "ai_summary"), ("summary", "ai_summary"), ("תקציר", "ai_summary"),
]
RECIPE_QUESTION_WORDS = ["מתכון", "מתכונים", "מצרכים", "איך מכינים", "recipe"]
RECIPE_LIST_WORDS = ["מתכונים", "איזה מתכונים"]
RECIPE_HOWTO_WORDS = ["איך מכינים", "הוראות"]
RECIPE_INGREDIENT_WORD = "מצרכים"
ANSWER_NOT_FOUND = "המידע הזה לא זמין במסמך"
ANSWER_NO_RECIPES = "לא נמצאו מתכונים במסמך הזה"
ANSWER_MODEL_DECLINED = "לא נמצא מידע"
RECENCY_WORDS = ["אחרון", "last", "latest", "recent", "האחרון"]
VIEWS = {
    "active_contracts": {"doc_type": "contract"},
    "insurance_documents": {"doc_type": "insurance"},
    "recent_invoices": {"doc_type": "invoice", "limit": 10},
    "needs_review": {"review_state": "needs_review"},
}
TYPE_WORDS = {
    "חוזים": "contract", "contracts": "contract",
    "חשבוניות": "invoice", "invoices": "invoice",
    "קבלות": "receipt", "receipts": "receipt",
    "ביטוח": "insurance", "insurance": "insurance",
    "אחריות": "warranty", "warranty": "warranty",
    "דפי חשבון": "bank_statement", "bank statements": "bank_statement",
    "כרטיס אשראי": "credit_card_statement", "credit card": "credit_card_statement",
}
FALLBACK_WORDS = [
    "מסמך", "חשבונית", "ביטוח", "חוזה", "קבלה", "פוליסה", "תשלום", "הסכם", "חשבון", "אחריות", "ערבות", "שטר", "תעודה",
]
LEADING_QUESTION_WORDS = ["מה ", "כמה ", "איזה ", "מי ", "האם ", "איפה ", "מתי ", "איך ", "למה "]

# --- access (fixed values) ----------------------------------------------------------------------
ACCESS_MATRIX = {
    "librarian": {
        "documents": "read_write", "document_facts": "read_write", "salary_slips": "read", "utility_bills": "read",
        "contracts": "read", "insurance_policies": "read", "tasks": "read_write", "memories": "read_write",
        "family_members": "metadata", "conversations": "none",
    },
    "finance_agent": {
        "documents": "read", "document_facts": "read", "salary_slips": "read", "utility_bills": "read",
        "contracts": "read", "insurance_policies": "none", "tasks": "read", "memories": "none",
        "family_members": "metadata", "conversations": "none",
    },
    "insurance_agent": {
        "documents": "read", "document_facts": "read", "salary_slips": "none", "utility_bills": "none",
        "contracts": "read", "insurance_policies": "read", "tasks": "read", "memories": "none",
        "family_members": "metadata", "conversations": "none",
    },
    "orchestrator": {
        "documents": "metadata", "document_facts": "metadata", "salary_slips": "metadata",
        "utility_bills": "metadata", "contracts": "metadata", "insurance_policies": "metadata",
        "tasks": "read_write", "memories": "read", "family_members": "metadata", "conversations": "read",
    },
}
# required level -> granted levels that satisfy it
ACCESS_GRANTS = {
    "none": ["none", "metadata", "read", "write", "read_write"],
    "metadata": ["metadata", "read", "write", "read_write"],
    "read": ["read", "read_write"],
    "write": ["write", "read_write"],
    "read_write": ["read_write"],
}
METADATA_COLUMNS = [
    "doc_id", "doc_type", "vendor", "amount", "currency", "doc_date", "display_name", "review_state", "tags", "created_at",
]
FULL_COLUMNS = METADATA_COLUMNS + ["filename", "raw_text", "ai_summary", "confidence", "source"]
# role, resource, can_read, can_write
ROLE_GRANTS = [
    ("parent", "finance", True, True),
    ("parent", "documents", True, True),
    ("parent", "tasks", True, True),
    ("child", "finance", False, False),
    ("child", "documents", True, False),
    ("child", "tasks", True, True),
    ("grandparent", "finance", False, False),
    ("grandparent", "documents", True, False),
    ("grandparent", "tasks", True, False),
]
OPEN_FACT_CATEGORIES = ["basic_personal", "household_access"]
PARENT_FACT_CATEGORIES = ["financial", "health"]
BASIC_PERSONAL_KEYS = ["birth_date", "id_number", "gender", "spouse"]
SELF_WORDS = ["i", "me", "my", "myself", "אני", "עצמי", "שלי", "נולדתי"]
SPOUSE_WORDS = ["my wife", "wife", "אשתי", "spouse", "בן הזוג שלי", "בת הזוג שלי"]

# --- tasks and recurring patterns (fixed values) ------------------------------------------------
PRIORITY_ORDER = {"urgent": 0, "high": 1, "normal": 2, "low": 3}
UNKNOWN_PRIORITY_RANK = 99
PRIORITY_WORDS = [
    ("דחוף", "urgent"), ("urgent", "urgent"), ("גבוה", "high"), ("high", "high"), ("רגיל", "normal"),
    ("normal", "normal"), ("נמוך", "low"), ("low", "low"),
]
DUE_DATE_PATTERN = r"(?:עד|due|תאריך)\s*(\d{4}-\d{2}-\d{2})"
TITLE_PATTERN = r"(?:כותרת|title)\s+(.+?)(?:\s+(?:עד|due|עדיפות|priority)|$)"
ASSIGNEE_SHORTHAND = r"^\s*(?:ל|עבור\s+)([^:-]+?)\s*[:\-]\s*(.+?)\s*$"
ASSIGNEE_PREFIXES = ["ל", "של "]
FREQUENCY_WORDS = {"יומי": "daily", "שבועי": "weekly", "חודשי": "monthly", "שנתי": "yearly"}
DEFAULT_FREQUENCY = "monthly"
DAY_OF_MONTH_PATTERN = r"ב[־\-](\d{1,2})"
DUPLICATE_TASK_SECONDS = 300
ENUM_DOMAINS = {
    "role": ["parent", "child", "grandparent", "other"],
    "document_source": ["whatsapp", "email", "filesystem", "manual", "text_message"],
    "direction": ["income", "expense"],
    "frequency": ["daily", "weekly", "monthly", "yearly"],
    "task_status": ["open", "in_progress", "done", "archived"],
    "task_priority": ["low", "normal", "high", "urgent"],
    "memory_category": ["preference", "goal", "fact", "habit", "context"],
    "memory_type": ["short", "medium", "long", "permanent"],
    "memory_source": ["conversation", "document", "manual", "system"],
    "exclusion_type": ["keyword", "category", "regex"],
    "bug_status": ["open", "fixed", "wont_fix", "duplicate"],
    "bug_priority": ["low", "normal", "high", "critical"],
    "fact_category": ["basic_personal", "household_access", "financial", "health"],
}

# --- memories (fixed values) --------------------------------------------------------------------
MEMORY_CATEGORIES = ["preference", "goal", "fact", "habit", "context"]
MEMORY_CATEGORY_MAP = {"task": "context", "reminder": "context", "note": "fact", "info": "fact", "memory": "fact"}
MEMORY_DEFAULT_CATEGORY = "context"
MEMORY_TTL_DAYS = {"short": 7, "medium": 90, "long": 365, "permanent": None}
# pattern, type
MEMORY_EXCLUSIONS = [
    ("סיסמה", "keyword"),
    ("password", "keyword"),
    ("קוד", "keyword"),
    ("PIN", "keyword"),
    ("תעודת זהות", "keyword"),
    ("כרטיס אשראי", "keyword"),
    ("credit card", "keyword"),
    ("credentials", "category"),
    ("secret", "keyword"),
]
NUDGE_PHRASES = [
    "הקוד הוא", "הקוד שלי", "הסיסמה היא", "המספר הוא", "המספר שלי", "הכתובת היא", "הכתובת שלי", "יום הולדת",
    "אלרגי ל", "אלרגית ל", "אני אוהב", "אני אוהבת", "אני לא אוהב", "אני לא אוהבת", "אני צריך", "אני צריכה",
    "תזכור ש", "תזכרי ש", "חשוב לדעת", "שים לב ש", "the code is", "the password is", "my number is", "remember that",
]
NUDGE_CONTENT_CAP = 500

BIRTH_STATEMENT = (
    r"(\w+)\s+(?:was born|נולדה|נולד)\s+(?:on|ב)\s*(\d{1,2}[./]\d{1,2}[./]\d{2,4})"
)
ID_STATEMENT = r"(\w+).{0,12}(?:id|תעודת זהות|תז)[^\d]*(\d{5,12})"
BUILDING_CODE_STATEMENTS = [
    r"([\w\s\-']+?)\s+(?:building\s*code|code|קוד כניסה|קוד בניין|קוד)[^\d]*(\d{3,10})",
    r"(?:building\s*code|קוד בניין|קוד כניסה)\s+(?:of|for|של)\s+([\w\s\-']+)[^\d]*(\d{3,10})",
]

# --- messages (fixed values; ordered) -----------------------------------------------------------
INTENT_PATTERNS = [
    ("documents", r"סכום|חשבונית|מסמך|קובץ|תשלום|ביטוח|חוזה|קבלה|ספק"),
    ("documents", r"מה כתוב|מה רואים|מה המספר|כמה שילמ"),
    ("documents", r"document|invoice|receipt|contract"),
    ("tasks", r"משימה|לעשות|צור משימה|הוסף משימה|סמן|מחק משימה|task"),
    ("recipes", r"מתכון|בישול|מרכיב|להכין|recipe"),
    ("memory", r"זכור|זיכרון|שמור לזכרון|memory"),
    ("recurring", r"חוזר|כל שבוע|כל חודש|תזכורת קבועה|recurring"),
    ("bugs", r"תקלה|באג|שגיאה|לא עובד|bug"),
    ("system", r"עזרה|פקודות|מה אתה יכול|help|בטל|cancel"),
]
ESCALATION_PATTERNS = [
    (r"(בנה|תבנה|לבנות|ליצור)\s+(כלי|יכולת|פיצ׳ר|פיצר|skill|tool)", "build_capability", "powerful"),
    (r"(תתכנן|לתכנן|ארכיטקטורה|עיצוב מערכת|system design)", "planning", "powerful"),
    (r"(רגשי|קשה לי|עצוב|מתוסכל|לא טוב לי|מרגיש|מרגישה)", "emotional", "powerful"),
    (r"(נתח|תנתח|ניתוח|אנליזה|analyze|analysis)", "deep_analysis", "powerful"),
    (r"(אסטרטגיה|תכנון ארוך טווח|roadmap|חזון)", "strategy", "powerful"),
    (r"(debug|דיבאג|באג מורכב|תקלה מורכבת)", "complex_debug", "powerful"),
    (r"(שפר|לשפר|אופטימיזציה|optimize|refactor|ריפקטור)", "optimization", "strong"),
]
# one more pattern names the assistant itself; it is built from the name the caller passes
FEATURE_REQUEST_PATTERNS = [
    (r"אני רוצה ש", "dev_plan"),
    (r"צריך להוסיף", "dev_plan"),
    (r"חסר לי", "dev_plan"),
    (r"אפשר לבנות", "dev_plan"),
    (r"למה אין", "dev_query"),
    (r"חבל שאין", "dev_plan"),
    (r"אפשר לשפר", "dev_plan"),
    (r"צריך לשנות", "dev_plan"),
    (r"יכולת חדשה", "dev_plan"),
    (r"פיצ.ר חדש", "dev_plan"),
    (r"we need", "dev_plan"),
    (r"can you build", "dev_plan"),
    (r"it would be nice if", "dev_plan"),
]
UPGRADE_CONFIRM = r"^(כן|בטח|יאללה|אישור|yes|sure|ok|אוקיי|בוא נעשה את זה|קדימה)$"
UPGRADE_DECLINE = r"^(לא|לא צריך|no|ביטול|cancel|עזוב|תשאר)$"
COMPLETION_PHRASE = r"^(תודה|סיימתי|done|thanks|bye|יאללה ביי|להתראות|תודה רבה)$"
CANCEL_COMMAND = r"^(לא|עזוב|תעזוב|בטל|תבטל|ביטול|cancel)$"
CONFIRM_COMMAND = r"^(כן|yes|אישור|אשר|ok|בטח|אוקיי|אוקי)$"
DOWNGRADE_SIGNALS = ["post_tool_chat", "user_done", "topic_shift"]
HISTORY_DEPTH = 4
HISTORY_SKIP_INTENTS = ["agent.None", "agent.chat", "agent.none"]
ERROR_REPLY = "מצטער, לא הצלחתי לעבד את הבקשה. נסה שוב."
RATE_WINDOW_SECONDS = 60
RATE_MAX_MESSAGES = 20
INACTIVITY_MINUTES = 10

# skill, pattern, action; the first match in this order decides
COMMAND_PATTERNS = [
    ("system", r"^(עזרה|help|פקודות)$", "help"),
    ("task", r"^תרשום\s+משימה\s+ל(?P<assignee_name>[^\s]+)(?:\s*[-:])?\s*(?P<title>.+)$", "create"),
    ("task", r"^תרשום ל(?P<assignee_name>[^\s]+)\s+משימה(?:\s*[-:])?\s*(?P<title>.+)$", "create"),
    ("task", r"^תוסיף\s+משימה\s+ל(?P<assignee_name>[^\s]+)(?:\s*[-:])?\s*(?P<title>.+)$", "create"),
    ("task", r"^תוסיף ל(?P<assignee_name>[^\s]+)\s+משימה(?:\s*[-:])?\s*(?P<title>.+)$", "create"),
    ("task", r"^למשימות של\s+(?P<assignee_name>[^\s]+)\s+תוסיף\s+(?P<title>.+)$", "create"),
    ("task", r"^משימה ל(?P<assignee_name>[^\s]+)(?:\s*[-:])?\s*(?P<title>.+)$", "create"),
    ("task", r"^משימה\s+(?P<index>\d+)\s+היא\s+של\s+(?P<assignee_name>[^\s]+)$", "reassign"),
    ("task", r"^תשייך\s+את\s+משימה\s+(?P<index>\d+)\s+ל(?P<assignee_name>[^\s]+)$", "reassign"),
    ("task", r"^זה\s+שייך\s+ל(?P<assignee_name>[^\s]+)$", "reassign"),
    ("task", r"^המשימה\s+הזאת\s+של\s+(?P<assignee_name>[^\s]+)$", "reassign"),
    ("task", r"^משימה חדשה[:\s]+(?P<title>.+)$", "create"),
    ("task", r"^משימה[:\s\-]+(?P<title>.+)$", "create"),
    ("task", r"^new task[:\s]+(?P<title>.+)$", "create"),
    ("task", r"^מחק משימה\s+(?P<index>\d+)$", "delete"),
    ("task", r"^מחק משימה[:\s]+(?P<title_query>.+)$", "delete"),
    ("task", r"^מחק\s+(?P<index>\d+)$", "delete"),
    ("task", r"^מחק\s+את\s+(?P<index>\d+)$", "delete"),
    ("task", r"^מחיקה\s+(?P<index>\d+)$", "delete"),
    ("task", r"^מחיקה\s+את\s+(?P<index>\d+)$", "delete"),
    ("task", r"^מחק\s+משימות\s+(?P<indices_csv>\d+(?:\s*,\s*\d+)*)$", "delete_many"),
    ("task", r"^(מחק הכל|נקה הכל|delete all)$", "delete_all"),
    ("task", r"^(סיים|סיום|בוצע|סיימתי)\s*(משימה)?\s*(?P<index>\d+)?$", "complete"),
    ("task", r"^(סיים|סיום|בוצע|סיימתי)[:\s]+(?P<title_query>.+)$", "complete"),
    ("task", r"^done\s*(?P<index>\d+)?$", "complete"),
    ("task", r"^(עדכן|שנה|תעדכן|תשנה)\s*(משימה)?\s*(?P<index>\d+)?\s*(?P<changes>.*)$", "update"),
    ("task", r"^משימות$", "list"),
    ("task", r"^מה\s+המשימות(?:\s+הפתוחות)?\s+שלי\s*\??$", "list"),
    ("task", r"^איזה\s+משימות(?:\s+יש\s+לי)?\s*\??$", "list"),
    ("task", r"^יש\s+לי(?:\s+עוד)?\s+משימות\s*\??$", "list"),
    ("task", r"^tasks$", "list"),
    ("document", r"^(מסמכים|documents)$", "list"),
    ("document", r"^(נקה מסמכים|מחק מסמכים|מחק את כל המסמכים)$", "delete_documents"),
    ("document", r"איזה מסמכים", "list"),
    ("document", r"אילו מסמכים", "list"),
    ("document", r"מה המסמכים", "list"),
    ("document", r"רשימת מסמכים", "list"),
    ("document", r"הצג מסמכים", "list"),
    ("document", r"כל המסמכים", "list"),
    ("document", r"הראה מסמכים", "list"),
    ("document", r"^(מסמכים אחרונים|recent documents)$", "recent_feed"),
    ("document", r"^show latest (?P<limit>\d{1,2}) documents$", "recent_feed"),
    ("document", r"^(מסמך אחרון|latest document|last document|המסמך האחרון)$", "recent"),
    ("document", r"^תייג את המסמך הזה כ\s*#(?P<tag>[\w\-]+)$", "tag_add"),
    ("document", r"^תוסיף תגית\s*#(?P<tag>[\w\-]+)$", "tag_add"),
    ("document", r"^הסר תגית\s*#(?P<tag>[\w\-]+)$", "tag_remove"),
    ("document", r"^(show tags for this document|הצג תגיות למסמך הזה)$", "tag_show"),
    ("document", r"^(documents tagged|מסמכים עם תגית)\s*#(?P<tag>[\w\-]+)$", "tag_search"),
    ("document", r"^(active contracts|חוזים פעילים)$", "view_active_contracts"),
    ("document", r"^(insurance documents|מסמכי ביטוח)$", "view_insurance_documents"),
    ("document", r"^(recent invoices|חשבוניות אחרונות)$", "view_recent_invoices"),
    ("document", r"^(documents needing review|מסמכים לבדיקה)$", "view_needs_review"),
    ("document", r"^(?:הראה|show|חפש|find)\s+(?P<doc_type>חוזים|contracts|חשבוניות|invoices|קבלות|receipts|ביטוח|insurance|אחריות|warranty|דפי חשבון|bank statements|כרטיס אשראי|credit card)", "search"),
    ("document", r"^(?:חפש|find)\s+(?:מסמך|document|קבלה|receipt)?\s*(?:מ|from|של|by)?\s+(?P<keyword>.+)", "search"),
    ("document", r"^(?:תביא|תראה|מצא|תמצא)\s+לי\s+(?P<doc_name>.+)", "fetch"),
    ("document", r"^(?P<question>(?:מה סוג|what type|כמה עולה|what.+amount|מי ה|who.+counterparty|תן לי סיכום|give me a summary|מה הסכום|what is the amount|מה התאריך|what is the date).+)", "query"),
    ("document", r"^(מתכונים|מתכונים שלי|הראה מתכונים)$", "recipe_list"),
    ("document", r"^(?:יש לי|איזה)\s+(?:מתכונים)", "recipe_list"),
    ("document", r"^(?:מה יש לי|מה יש)\s+(?:מתכונים)", "recipe_list"),
    ("document", r"^(?:חפש מתכון|יש מתכון ל)\s*(?P<recipe_query>.+)", "recipe_search"),
    ("document", r"^(?:איך מכינים|מה המתכון ל)\s*(?P<recipe_name>.+)", "recipe_howto"),
    ("document", r"^(?:מה יש ב|מתכונים של|מתכונים ב)\s*(?P<doc_query>.+)", "recipe_in_doc"),
    ("document", r"^(?:חפש|search)\s+(?P<keyword>.+)", "search"),
    ("document", r"(?:מתכון|מתכונים|recipe)", "recipe_fallback"),
    ("document", r"(?:מסמך|חשבונית|ביטוח|חוזה|קבלה|פוליסה|תשלום|הסכם|חשבון|אחריות|ערבות|שטר|תעודה)", "doc_search_fallback"),
    ("bug", r"^באג[:\s]+(?P<description>.+)$", "report"),
    ("bug", r"^bug[:\s]+(?P<description>.+)$", "report"),
    ("bug", r"^(באגים|bugs|רשימת באגים)$", "list"),
    ("chat", r"^(שלום|היי|hello|בוקר טוב|ערב טוב|לילה טוב)$", "greet"),
    ("recurring", r"^תזכורת חדשה[:\s]+(?P<title>.+)$", "create"),
    ("recurring", r"^recurring[:\s]+(?P<title>.+)$", "create"),
    ("recurring", r"^(תזכורות|חוזרות|recurring)$", "list"),
    ("recurring", r"^(מחק|בטל) תזכורת\s*(?P<index>\d+)?$", "delete"),
    ("morning", r"^(בוקר|morning|סיכום בוקר)$", "briefing"),
    ("morning", r"^(סטטוס|status)$", "status"),
    ("morning", r"^(דוח|report|סיכום)$", "summary"),
    ("memory", r"^(זכרונות|memories)$", "list"),
    ("fact", r"(?:נולד|נולדה|was born|born on)", "store_birth_date"),
    ("fact", r"(?:תעודת זהות|\bID\b).*(?:של|of)?", "store_or_query_id"),
    ("fact", r"(?:when was i born|מתי נולדתי|מתי נולדתי\?)", "query_self_birth"),
    ("fact", r"(?:מתי .*נולד|תאריך לידה|date of birth)", "query_birth"),
    ("fact", r"(?:building code|קוד בניין|קוד כניסה|מה הקוד של)", "store_or_query_building_code"),
]
