"""Wording, limits and patterns that decide results. Plain text, in natural order."""

# Words that make a text a rent advert.
HARD_RENT = [
    r"\bfor\s+rent\b", r"\bfor\s+lease\b", r"\bto\s+let\b", r"\brent\b", r"\brental\b", r"\brented\b", r"\bto rent\b",
    r"\bper year\b", r"\bper month\b", r"\bper annum\b", r"\b/yr\b", r"\b/year\b", r"\b/month\b", r"\b/мес\b", r"\b/год\b",
    r"\bаренда\b", r"\bснять\b", r"\bсниму\b", r"\bсдам\b", r"\bсдается\b", r"\bсдаётся\b",
    r"للإيجار", r"للتأجير", r"\bإيجار\b", r"\bمؤجر\b", r"\bمؤجرة\b", r"\bسنوياً?\b", r"\bشهرياً?\b", r"\bسنوي\b", r"\bشهري\b",
    r"\bتأجير\b", r"إيجاره\b", r"إيجارها\b", r"قابل\s+للإيجار", r"متاح\s+للإيجار",
]
# Words that make a text a sale advert.
HARD_SALE = [
    r"\bfor sale\b", r"\bselling\b", r"\bresale\b", r"\bsale price\b", r"\bsales?\s+price\b", r"\bselling\s+price\b",
    r"\bsp\s*[:\-]", r"\bop\s*[:\-]", r"\bpayment\s+plan\b", r"\bhandover\s+(?:q\d|in|date|by|on|\d{4})",
    r"\b(?:urgent|hot|distress)\s+sale\b", r"\bbelow\s+market\b", r"\bbelow\s+op\b", r"\boff[\s\-]?plan\b", r"\bdeveloper\s*:", r"\bproject\s*:",
    r"\bпродажа\b", r"\bпродам\b", r"\bпродаётся\b", r"\bbuy\b", r"\bbuying\b",
    r"للبيع", r"\bبيع\b", r"\bيُباع\b", r"\bيباع\b", r"خطة\s+الدفع", r"خطة\s+دفع", r"على\s+المخطط", r"تحت\s+الإنشاء", r"وحدة\s+للبيع",
    r"سعر\s+البيع", r"سعر\s+الطلب", r"بيع\s+عاجل", r"تنازل", r"\bمشروع\b",
]
RENT_CONTEXT = r"\bcheques?\b|\bper\s+month\b|/month\b|\bmonthly\b|\bper\s+year\b|/year\b|\bper\s+annum\b|\bannually\b"
BUYER_REQUEST = [
    r"buyer.{0,10}request", r"looking.{0,20}(?:buy|purchase|invest)", r"\bcash\s+buyer\b",
    r"\bseeking\s+(?:a\s+)?\d?\s*(?:bedroom|br|bhk|studio|villa|apartment|townhouse|plot|residence)",
    r"looking\s+for\s+(?:a\s+|my\s+)?(?:client|investor)", r"\bclient\s+(?:is\s+)?looking\s+(?:to\s+)?(?:buy|purchase|invest)",
    r"\bbudget\s*[:=]?\s*(?:up\s+to|aed|\$)",
]
OFFER_WORDS = r"\b(?:selling\s+price|asking\s+price|sales?\s+price|sp\s*:|op\s*:|for\s+sale\b)\b"
EXPLICIT_SALE = (
    r"\b(?:for\s+sale|sales?\s*price|selling\s*price|sale\s*price|asking\s*price|sp\s*[:\-]|original\s*price|op\s*[:\-]|payment\s*plan|"
    r"handover(?:\b|\s+(?:q\d|in|by|on|\d{4}|ongoing|ready))|distress\s+deal|below\s+(?:market|op)|off[\s\-]?plan|developer\s*:|"
    r"urgent\s+sale|hot\s+sale|fully\s+paid|paid\s+\d+%|price\s*[:\-]?\s*[\d.,]+\s*(?:m\b|mln|million)|"
    r"aed\s*[\d.,]+\s*(?:m\b|mln|million)|\d+\s*(?:m\b|mln|million)(?!\w))\b"
)
RENT_OVER_1M_SALE = (
    r"\b(?:for\s+sale|sales?\s*price|selling\s*price|sale\s*price|asking\s*price|payment\s+plan|handover|distress\s+deal|below\s+(?:market|op)|"
    r"off[\s\-]?plan|developer\s*:|aed\s*[\d.,]+\s*(?:m\b|mln|million))\b|\bsp\s*[:\-]"
)
MOTIVATED_SALE = r"\b(?:motivated\s+seller|owner\s+motivated|must\s+sell|urgent\s+sale|resale|for\s+sale|selling|open\s+to\s+offers|price\s+negotiable)\b"

# Deal-quality and investment constants.
DEFAULT_MARKET = {"sqft": 1300, "rent_1br": 80000, "growth": 4}
RENT_MULTIPLIER = {"studio": 0.7, "1br": 1.0, "2br": 1.6, "3br": 2.2, "4br+": 3.0}
BANK_DEPOSIT_RATE = 4.0
DEFAULT_ROI = 7.0
DEFAULT_GROWTH = 6.0
MIN_RENT_BY_BEDROOMS = {1: 40000, 2: 60000, 3: 90000, 4: 120000}
MIN_SALE_BY_BEDROOMS = {1: 500000, 2: 900000, 3: 1500000, 4: 2500000}
RESIDENTIAL = ["apartment", "villa", "townhouse", "penthouse", "studio", "duplex"]
BENCHMARKED_TYPES = ["apartment", "villa", "townhouse", "penthouse", "studio"]
BUILDING_DESCRIPTORS = r"(?i)\b(?:view|deal|vacant|rented|brand new|fully|distress|hot|asking)\b"


def any_of(patterns: list[str]) -> str:
    """One Unicode-aware, case-blind pattern out of several."""
    return "(?iuU)(?:" + "|".join(patterns) + ")"
