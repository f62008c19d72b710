"""Word lists and patterns whose contents and order are part of the semantics."""

from __future__ import annotations

# Known merchants and their aliases, in matching order.
MERCHANTS = [
    ("Swiggy Instamart", ["swiggy instamart", "instamart"]),
    ("Swiggy", ["swiggy"]),
    ("Zomato", ["zomato", "zomatofo"]),
    ("Uber", ["uber", "uber india"]),
    ("Ola", ["ola", "olacabs"]),
    ("Rapido", ["rapido"]),
    ("Blinkit", ["blinkit", "grofers"]),
    ("Zepto", ["zepto"]),
    ("BigBasket", ["bigbasket", "big basket"]),
    ("Amazon", ["amazon", "amzn"]),
    ("Flipkart", ["flipkart"]),
    ("Myntra", ["myntra"]),
    ("Ajio", ["ajio"]),
    ("Netflix", ["netflix"]),
    ("Spotify", ["spotify"]),
    ("Youtube", ["youtube", "google oct"]),
    ("Apple", ["apple.com", "itunes"]),
    ("Google", ["google"]),
    ("Jio", ["jio", "reliance jio"]),
    ("Airtel", ["airtel"]),
    ("Vodafone", ["vi", "vodafone"]),
    ("Mcdonalds", ["mcdonalds", "mcdonald"]),
    ("Starbucks", ["starbucks"]),
    ("KFC", ["kfc"]),
    ("Burger King", ["burger king"]),
    ("Domino's", ["dominos", "domino's"]),
    ("Pizza Hut", ["pizza hut"]),
    ("Subway", ["subway"]),
]

# Noise that is taken out of descriptions of unknown merchants, in order.
MERCHANT_NOISE = ["UPI-[a-zA-Z0-9]+-", "UPI/", "NEFT-", "IMPS-", "Ach Debit", "Pos", "Wdl Tfr", "Tfr", "Dr", "Cr", "Mb", "[0-9]+", r"\s+"]

# Brands of one bank's statements and their aliases, matched without blanks first.
SBI_BRANDS = [
    ("Swiggy Instamart", ["swiggy instamart", "instamart"]),
    ("Swiggy", ["swiggy"]),
    ("Zomato", ["zomato", "zomatofo", "payzomato", "zomatofood", "zomato-ord"]),
    ("Uber", ["uber"]),
    ("Ola", ["ola", "olacabs", "olamon"]),
    ("Rapido", ["rapido"]),
    ("Blinkit", ["blinkit"]),
    ("Zepto", ["zepto", "zeptonow"]),
    ("BigBasket", ["bigbasket"]),
    ("Amazon", ["amazon", "amzn", "amazonpay"]),
    ("Flipkart", ["flipkart"]),
    ("Myntra", ["myntra"]),
    ("Netflix", ["netflix"]),
    ("Spotify", ["spotify"]),
    ("YouTube", ["youtube", "google"]),
    ("Jio", ["jio", "reliance"]),
    ("Airtel", ["airtel"]),
    ("PhonePe", ["phonepe", "phonpe"]),
    ("Paytm", ["paytm", "one97communica", "one97"]),
    ("Google Pay", ["googlepay", "gpay"]),
    ("CRED", ["cred"]),
    ("Dunzo", ["dunzo"]),
    ("Dream11", ["dream11"]),
    ("Groww", ["groww"]),
    ("Zerodha", ["zerodha"]),
    ("Slice", ["slice"]),
    ("Meesho", ["meesho"]),
    ("Nykaa", ["nykaa"]),
    ("BookMyShow", ["bookmyshow"]),
    ("IRCTC", ["irctc"]),
    ("MakeMyTrip", ["makemytrip"]),
    ("Ixigo", ["ixigo"]),
    ("BESCOM", ["bescom"]),
    ("Domino's", ["dominos", "domino"]),
    ("McDonald's", ["mcdonalds", "mcdonald"]),
    ("KFC", ["kfc"]),
    ("Starbucks", ["starbucks"]),
    ("Burger King", ["burgerking", "burger king"]),
]

# Keyword rules in matching order; keywords of up to four letters match whole words only.
KEYWORD_RULES = [
    ("Food", ["swiggy", "zomato", "blinkit", "zepto", "domin", "pizza", "burger", "kfc", "mcdonald", "starbuck", "cafe", "restaurant"]),
    ("Transport", ["uber", "ola", "rapido", "metro", "irctc", "fuel", "petrol", "shell"]),
    ("Shopping", ["amazon", "flipkart", "myntra", "ajio", "decathlon", "zudio", "retail"]),
    ("Entertainment", ["netflix", "spotify", "prime", "hotstar", "youtube", "steam", "pvr", "inox", "bookmyshow"]),
    ("Utilities", ["bescom", "bwssb", "airtel", "jio", "vodafone", "vi", "act", "bill"]),
    ("Health", ["pharmacy", "apollo", "medplus", "practo", "clinic", "hospital", "gym", "fitness"]),
    ("Finance", ["zerodha", "groww", "angel", "cred", "loan", "emi", "insurance", "tax"]),
]

# Categories of bank statements; keywords match anywhere, the merchant before the description.
BANK_CATEGORIES = [
    ("Food & Dining", ["swiggy", "zomato", "food", "restaurant", "cafe", "pizza", "burger", "mcdonalds", "kfc", "dominos", "subway", "starbucks"]),
    ("Transportation", ["uber", "ola", "rapido", "fuel", "petrol", "diesel", "transport", "irctc", "railway", "metro"]),
    ("Shopping", ["amazon", "flipkart", "myntra", "ajio", "shopping", "retail", "mall", "store"]),
    ("Groceries", ["blinkit", "zepto", "bigbasket", "grofers", "grocery", "supermarket", "dmart", "reliance fresh"]),
    ("Entertainment", ["netflix", "spotify", "youtube", "prime", "hotstar", "movie", "entertainment", "disney"]),
    ("Utilities", ["electricity", "water", "gas", "bill", "recharge", "jio", "airtel", "vodafone", "utility"]),
    ("Health & Wellness", ["pharmacy", "medical", "health", "hospital", "clinic", "apollo"]),
    ("Financial", ["emi", "loan", "insurance", "investment", "mutual fund", "sip"]),
    ("Cash", ["atm", "cash", "withdrawal"]),
    ("Transfer", ["upi", "neft", "imps", "rtgs", "transfer"]),
]

# Fallback categories for imports; keywords of up to four letters match whole words only.
IMPORT_CATEGORIES = [
    ("Food", ["swiggy", "zomato", "food", "restaurant", "dining", "blinkit", "zepto", "bigbasket", "grofers", "mcdonalds", "starbucks", "kfc", "burger king", "dominos", "pizza hut", "subway", "grocery", "groceries"]),
    ("Transport", ["uber", "ola", "rapido", "taxi", "cab", "bus", "train", "metro", "fuel", "petrol", "diesel", "parking"]),
    ("Utilities", ["electricity", "water", "gas", "airtel", "jio", "vodafone", "broadband", "wifi", "bescom", "bill", "recharge"]),
    ("Shopping", ["amazon", "flipkart", "myntra", "ajio", "shopping", "clothing", "meesho"]),
    ("Entertainment", ["netflix", "spotify", "youtube", "hotstar", "prime video", "movie", "cinema", "gaming", "xbox", "playstation"]),
    ("Health", ["medical", "doctor", "pharmacy", "hospital", "gym", "apollo", "health"]),
    ("Education", ["course", "tuition", "school", "college", "udemy", "coursera", "education"]),
    ("Finance", ["investment", "loan", "insurance", "mutual fund", "zerodha", "groww", "emi", "sip"]),
    ("People", ["sent to", "received from", "upi transfer", "upi received", "transfer to", "friend", "family"]),
]

# Words that are no part of a name in a statement's details.
DETAIL_PREFIXES = ["POS", "ATM", "PURCH", "PURCHASE", "OTHPG", "UPI", "WDL", "TFR", "ME", "MB", "IB", "DEP", "CR", "DR", "SBIPG", "Paym", "NEFT", "SBIN", "IMPS"]

# Fixed values: (pattern, replacement) in order, that make a description of capitals only.
CLEAN_STEPS = [
    (r"[*\-_]", " "),
    (r"[\w\.-]+@[\w\.-]+", ""),
    (r"UPI(?:-|/)?\d+\w*", ""),
    (r"UPI\s*-?", ""),
    (r"\b(POS|ECOM|ATM|MPS|IMPS|NEFT|RTGS|ACH|MBk|WDL)\b", ""),
    (r"\d{2}[-/]\d{2}[-/]\d{2,4}", ""),
    (r"\d{2}[A-Z]{3}", ""),
    (r"\b\d{4,}\b", ""),
    (r"\b(TXN|REF|ID|NO|TRANSFER|PAYMENT|TO|BY|FROM|BILL|IN|VIA)\b", ""),
    (r"[^A-Z\s]", " "),
    (r"\s+", " "),
]

# Fixed values: (pattern, replacement) in order, that take codes out of details.
DETAIL_STEPS = [
    *[(rf"(?i)\b{p}\b", "") for p in DETAIL_PREFIXES],
    (r"(?i)\bSBIN[A-Z0-9]+\b", ""),
    (r"\bAT \d{4,}\b.*", ""),
    (r"\b\d{2}RAZ\*", ""),
    (r"\d{2}[/-]\d{2}[/-]\d{2,4}", ""),
    (r"\b\d{6,}\b", ""),
    (r"(\d+)([A-Za-z]+)", "$1 $2"),
    (r"\b\d+\b", ""),
    (r"[\n\r\t]", " "),
    (r"[^\p{L}\p{N}_\s]", " "),
    (r"\s+", " "),
]

# Fixed values: (pattern, placeholder) in order, for what varies between similar descriptions.
GROUP_STEPS = [
    (r"#\d+[-\d]*", "#ORDER"),
    (r"(?i)\btxn_\d+", "txn_XXXXX"),
    (r"(?i)UPI/([^/]+)/\d+", "upi/$1/XXXXXXXXX"),
    (r"-\d+@", "-XXXXX@"),
    (r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b", "DD/MM/YYYY"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "YYYY-MM-DD"),
    (r"(?i)\b(RS\.?|INR|₹)\s*(\d+\.?\d*)", "$1 XXXX.XX"),
    (r"\b\d{5,}\b", "XXXXX"),
]

# Names in transfers, and personal data.
P2P_NAME = r"(?i)(?:UPI|UPVDR|UPS|IMPS|NEFT)(?:/|-)\d+(?:/|-)([^/]+)(?:/|-)"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"

# What readable names are found by.
READ_PERSON = r"(?i)(?:UPI|UPVDR|UPS|IMPS|NEFT)(?:/|-)(?:DR|CR)?(?:/|-)?\d+(?:/|-)([^/]+)(?:/|-)"
READ_SHOP = r"(?i)POS\s+ATM\s+PURCH\s+\w+\s+\d+\s*\d*([A-Za-z*]+[A-Za-z\s]*)"
READ_REFUND = r"(?i)DEP\s+TFR\s+VISA-IN-RMT:[0-9]+([A-Za-z]+)"
READ_BARE = [(r"(?i)\b(UPI|IMPS|NEFT|RTGS|ACH|NACH|WDL|TFR|POS|MB|DR|CR|DEP|OTHPG|SBIPG|PURCH|ATM)\b", ""), (r"[0-9]+", " "), (r"[^a-zA-Z\s]", " "), (r"\s+", " ")]

# Patterns of payment methods, in matching order.
METHOD_PATTERNS = [
    ("UPI", [r"(?i)UPI/([A-Z]+)/(\d+)/([^/]+)/([^/]+)/?([^/\s]*)", r"(?i)UPI-([A-Z]+)-(\d+)-([^/]+)-"]),
    ("POS", [r"(?i)POS\s+(?:PURCH|DEBIT|CREDIT)?\s*(\d*)\s*([^\d].*?)(?:\s+\d{2}[/-]\d{2})?$", r"(?i)POS\s+(.*?)(?:\s+\d{4})?$"]),
    ("ATM", [r"(?i)ATM\s+(?:WDL|DEP|WITHDRAWAL|DEPOSIT)\s*(\d*)\s*(.*)", r"(?i)ATM\s+(.*)"]),
    ("INB", [r"(?i)INB\s+(.*?)(?:\s+\d{4})?$", r"(?i)IB\s+(.*?)(?:\s+\d{4})?$"]),
    ("NEFT", [r"(?i)NEFT-[A-Z]*-?(\d+)-([^-]+)", r"(?i)NEFT/[^/]+/(\d+)/([^/]+)"]),
    ("IMPS", [r"(?i)IMPS-[A-Z]*-?(\d+)-([^-]+)", r"(?i)IMPS/[^/]+/(\d+)/([^/]+)"]),
    ("CASH", [r"(?i)CASH\s+(?:DEPOSIT|WITHDRAWAL|DEP|WDL)\s+(.*)", r"(?i)CASH\s+(.*)"]),
]

# Patterns of two kinds of statements.
STATEMENT_UPI = r"UPI/([A-Z]+)/(\d+)/([^/]+)/([^/]+)/([^/]+)"
STATEMENT_WIRE = r"(?:NEFT|RTGS)/([^/]+)/([^/]+)/([^/]+)"
STATEMENT_PERSON = r"(?:OF|of)\s+(?:Mr|Mrs|Ms|Miss|MR|MRS|MS)?\s*\.?\s*([A-Z][A-Z\s]+)"
CARD_WORDS = ("POS", "ATM", "PURCH", "OTHPG", "SBIPG", "DBTPG")
SBI_UPI = r"^(WDL|DEP) TFR\s+UPI/(DR|CR)/([^/]+)/([^/]+)/([^/]+)/([^/]+)/([^\s/]+)"
SBI_POS = r"^POS ATM PURCH\s+(\S+)\s+(\S+)\s+(.*)$"
SBI_ATM = r"^ATM WDL\s+ATM CASH\s+(.*)$"
SBI_INB = r"^WDL TFR\s+INB\s+(.*?)(?:\.\.\.|\s+AT\s+\d+)"
SBI_CDM = r"^CEMTEX DEP\s+(\S+)"

# Segments of a description that name no one.
NOISE_SEGMENTS = ["UPI", "IMPS", "NEFT", "RTGS", "ACH", "NACH", "CREDIT", "DEBIT", "PAYMENT", "TRANSFER", "BANK", "AXIS BANK", "HDFC BANK", "SBI", "ICICI", "YES BANK", "KOTAK", "WDL", "TFR", "POS", "MB"]

# Header names of delimited files, by target, in order of preference.
HEADER_SYNONYMS = {
    "date": ["date", "time", "transaction_date", "transaction date", "posting date", "trans date", "posting_date", "trans_date"],
    "description": ["description", "desc", "original description", "memo"],
    "merchant": ["merchant", "merchant name", "payee"],
    "amount": ["amount", "value", "amt"],
    "debit": ["debit", "withdrawal", "dr"],
    "credit": ["credit", "deposit", "cr"],
    "status": ["status", "state", "transaction status"],
    "method": ["payment method", "payment_method", "mode", "payment mode"],
    "product": ["product", "item", "product name"],
}

# Header names of banks' statements, by target.
STATEMENT_SYNONYMS = {
    "date": ["date", "transaction date", "txn date", "value date", "posting date", "time", "timestamp"],
    "description": ["description", "particulars", "details", "narration", "transaction details", "remarks", "notes", "merchant_category", "product"],
    "debit": ["debit", "debit amount", "withdrawal", "dr", "dr amount", "outflow"],
    "credit": ["credit", "credit amount", "deposit", "cr", "cr amount", "inflow"],
    "amount": ["amount", "transaction amount", "txn amount", "amount (inr)", "amount (usd)", "amount (eur)"],
    "balance": ["balance", "closing balance", "running balance"],
    "type": ["type", "transaction type", "txn type", "dr/cr"],
}

# Parts of the headers of a details sheet, by target, in order, with what such a header may not hold.
DETAIL_PARTS = [("Date", ["date"], []), ("Details", ["detail", "narration", "desc"], []), ("Debit", ["debit", "dr"], []), ("Credit", ["credit", "cr"], ["balance"])]

# Formats of dates in banks' statements, in order.
STATEMENT_DATES = ["d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "yyyy/M/d", "d/M/yy", "d-M-yy", "M/d/yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-M-d H:m:s", "d/M/yyyy H:m:s"]

# Headers by which a bank's statements are known; of equals the first wins.
BANK_HEADERS = {
    "hdfc": ["date", "description", "debit", "credit", "balance"],
    "icici": ["date", "particulars", "debit", "credit", "balance"],
    "sbi": ["date", "description", "debit", "credit", "balance"],
    "axis": ["date", "particulars", "debit", "credit", "balance"],
    "generic": ["date", "description", "amount"],
}

# Descriptions by which a bank's statements are known.
BANK_DESCRIPTIONS = {
    "hdfc": ["UPI/[A-Z]+/\\d+/[^/]+/", "POS\\s+", "ATM\\s+WDL"],
    "icici": ["UPI-[A-Z]+-\\d+-", "POS\\s+", "ATM\\s+"],
    "sbi": ["UPI/[A-Z]+/\\d+/[^/]+/", "POS\\s+", "ATM\\s+WDL"],
    "axis": ["UPI/[A-Z]+/\\d+/[^/]+/", "POS\\s+", "ATM\\s+"],
}

# Labels of the classifier.
CLASSIFIER_LABELS = ["Food", "Transport", "Utilities", "Salary", "Shopping", "Entertainment", "Health", "Education", "Finance", "People", "Misc"]
