"""Fixed values and default parameters.

Everything here is data that must have exactly these values for results to be right:
word lists, lookup tables, thresholds and formats.  Operators take them as arguments, so
a deployment can pass its own tables (see ``termsheet.sources.config_tables``).
"""

# ---- fixed values: thresholds and sizes --------------------------------------------------
STAGE_TWO_BELOW = 0.75          # stage-1 confidence below this asks for a second pass
UNKNOWN_BELOW = 0.60            # confidence below this forces model "unknown"
GATE_CONFIDENCE = 0.80          # below this a classification waits for review
LOW_FIELD_CONFIDENCE = 0.80     # field confidence below this is flagged
SECTION_MERGE_DELTA = 0.15      # a later section must beat an earlier one by this much
COVER_CHARS = 4_000
KEY_TERMS_WINDOW = 120_000
KEY_TERMS_LEAD_IN = 200
SECTION_LEAD_IN = 500
MIN_SLICE_CHARS = 100
TARGET_LEAD_IN = 200
TARGET_WINDOW = 1_500
TARGET_CAP = 8_000
TARGET_JOINER = "\n\n[...]\n\n"
EXCERPT_CHARS = 500
SAMPLE_CHARS = 200
TITLE_CHARS = 300
HISTORY_TURNS = 10
MAX_IMAGES = 30
TABLE_CONFIDENCE = 0.97

# ---- fixed values: image extensions ------------------------------------------------------
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".bmp", ".webp"]

# ---- fixed values: month names (full and three-letter) -> month number -------------------
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}

# ---- fixed values: currency codes and dollar spellings -----------------------------------
CURRENCY_CODES = ["USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "NZD", "HKD", "SGD",
                  "NOK", "SEK", "DKK"]
DOLLAR_SPELLINGS = ["U.S. DOLLAR", "US DOLLAR", "UNITED STATES DOLLAR"]

# ---- fixed values: frequency words, tested in this order ---------------------------------
FREQUENCY_WORDS = [
    ("monthly", ["month"]),
    ("quarterly", ["quarterly", "per quarter", "each quarter"]),
    ("semiAnnually", ["semi-annual", "semiannual", "semi annual", "every six"]),
    ("annually", ["annual", "per year", "each year", "yearly"]),
    ("weekly", ["weekly", "per week", "each week"]),
    ("daily", ["daily", "per day", "each day"]),
]

# ---- fixed values: observation words, tested in this order -------------------------------
OBSERVATION_WORDS = [
    ("european", ["european", "at maturity", "final"]),
    ("american", ["american", "daily", "continuous"]),
    ("periodic", ["periodic", "observation date"]),
]

# ---- fixed values: field path -> value kind ----------------------------------------------
PARSER_KINDS = {
    "identifiers.cusip": "cusip",
    "identifiers.isin": "isin",
    "structuredProductsGeneral.maturityDate": "date",
    "structuredProductsGeneral.tradeDate": "date",
    "structuredProductsGeneral.issueDate": "date",
    "structuredProductsGeneral.valuationDate": "date",
    "structuredProductsGeneral.notional": "amount",
    "structuredProductsGeneral.currency": "currency",
    "product.denomination": "amount",
    "structuredProductsGeneral.term": "text",
    "coupon.rate": "percentage",
    "coupon.barrierLevel": "percentage",
    "coupon.frequency": "frequency",
    "barrier.triggerDetails.triggerLevel": "percentage",
    "barrier.triggerDetails.observationType": "observation",
    "autocall.callLevel": "percentage",
    "underlyingTerms.underlyingAssets[*].name": "text",
    "underlyingTerms.underlyingAssets[*].initialLevel": "number",
    "underlyingTerms.underlyingAssets[*].finalLevel": "number",
    "underlyingTerms.underlyingAssets[*].bloombergTicker": "text",
    "parties.issuer.name": "text",
    "parties.guarantor.name": "text",
    "parties.calculationAgent.name": "text",
}

# Optional alias rows: the label map writes "...Generic.*" while the kinds above are filed
# under "...General.*".  By default such values stay raw text; adding these rows to the
# registry gives them the typed parser instead.
PARSER_KIND_ALIASES = {
    path.replace("General.", "Generic."): kind
    for path, kind in PARSER_KINDS.items() if path.startswith("structuredProductsGeneral.")
}

# ---- fixed values: shared label map (label text -> field path) ---------------------------
SHARED_LABELS = {
    "identifiers.cusip": ["cusip", "cusip no.", "cusip no", "cusip number", "cusip/isin"],
    "identifiers.isin": ["isin", "isin no."],
    "structuredProductsGeneric.maturityDate": [
        "maturity date", "stated maturity date", "final maturity date"],
    "structuredProductsGeneric.tradeDate": [
        "pricing date", "trade date", "initial valuation date"],
    "structuredProductsGeneric.issueDate": [
        "settlement date", "issue date", "original issue date",
        "original issue date (settlement date)"],
    "structuredProductsGeneric.valuationDate": [
        "valuation date", "final valuation date", "determination date",
        "final observation date"],
    "coupon.rate": [
        "contingent interest rate", "contingent coupon rate", "contingent coupon",
        "coupon rate", "interest rate"],
    "coupon.barrierLevel": [
        "coupon barrier level", "coupon barrier", "interest barrier", "coupon trigger level"],
    "coupon.frequency": [
        "coupon frequency", "payment frequency", "interest payment frequency"],
    "barrier.triggerDetails.triggerLevel": [
        "barrier level", "trigger level", "knock-in level", "knock-in barrier",
        "downside threshold", "threshold value", "trigger value", "trigger buffer level"],
    "autocall.callLevel": [
        "call level", "autocall level", "call threshold level", "call threshold levels",
        "optional early redemption level"],
    "underlyingTerms.underlyingAssets[*].name": [
        "reference asset", "underlying", "underlier", "index"],
    "underlyingTerms.underlyingAssets[*].initialLevel": [
        "initial level", "initial value", "starting value", "initial underlier level"],
    "underlyingTerms.underlyingAssets[*].finalLevel": ["final underlier value", "final value"],
    "underlyingTerms.underlyingAssets[*].bloombergTicker": [
        "bloomberg ticker", "bloomberg tickers", "ticker symbol"],
    "structuredProductsGeneric.notional": [
        "aggregate principal amount", "face amount", "total principal amount"],
    "product.denomination": [
        "denomination", "minimum denomination", "principal amount per note",
        "denominations", "minimum denominations"],
    "parties.issuer.name": ["issuer"],
    "parties.guarantor.name": ["guarantor"],
    "parties.calculationAgent.name": ["calculation agent"],
    "structuredProductsGeneric.currency": ["currency", "specified currency"],
    "structuredProductsGeneric.term": ["term", "tenor", "term of the notes"],
}

# ---- fixed values: default key-terms headings, tried in this order -----------------------
TABLE_HEADINGS = [
    "key terms and assumptions", "key terms", "terms of the notes", "supplemental terms",
    "product terms", "offering terms", "summary of terms",
]

# ---- fixed values: case-sensitive text anchors of the key-terms section ------------------
KEY_TERMS_ANCHORS = ["KEY TERMS", "Key Terms", "SUPPLEMENTAL TERMS", "TERMS OF THE NOTES",
                     "PRODUCT TERMS", "OFFERING TERMS"]

# ---- fixed values: structural feature words for the second classification pass -----------
FEATURE_WORDS = [
    "BARRIER", "TRIGGER", "KNOCK-IN", "KNOCK IN", "AUTOCALL", "AUTO CALL", "AUTOMATIC CALL",
    "BUFFER", "SOFT PROTECTION", "PARTIAL PROTECTION", "DIGITAL", "BINARY", "FIXED RETURN",
    "PARTICIPATION", "LEVERAGED", "COUPON", "CONTINGENT INTEREST", "CONDITIONAL COUPON",
    "PAYMENT SCHEDULE", "INTEREST PAYMENT", "UNDERLYING", "BASKET", "INDEX COMPONENT",
    "LEAST PERFORMING", "WORST OF", "WORST-OF", "BEST OF", "BEST-OF", "LOWEST PERFORMING",
    "PAYMENT AT MATURITY", "REDEMPTION AMOUNT", "PAYOUT", "PAYMENT UPON MATURITY",
    "CALCULATION OF PAYMENT", "ACCUMULATOR", "DECUMULATOR", "KNOCK-OUT FORWARD",
]

# ---- fixed values: product models and the sections each one is extracted from ------------
ALL_SECTIONS = ["identifiers", "product_generic", "underlying_terms", "protection",
                "autocall", "coupon", "parties"]
MODEL_SECTIONS = {
    "yieldEnhancementCoupon": ["identifiers", "product_generic", "underlying_terms",
                               "protection", "coupon", "parties"],
    "yieldEnhancementBarrierCoupon": ["identifiers", "product_generic", "underlying_terms",
                                      "protection", "coupon", "parties"],
    "yieldEnhancementAutocallCoupon": ALL_SECTIONS,
    "yieldEnhancementAutocallBarrierCoupon": ALL_SECTIONS,
    "yieldEnhancementAutocall": ["identifiers", "product_generic", "underlying_terms",
                                 "protection", "autocall", "parties"],
    "forwardKoStripEquity": ["identifiers", "product_generic", "underlying_terms", "parties"],
    "equityShare": ["identifiers", "parties"],
    "index": ["identifiers"],
    "depositaryReceipt": ["identifiers", "parties"],
}
MODELS = list(MODEL_SECTIONS)

# ---- fixed values: section name -> schema keys, search headers, slice length -------------
SECTIONS = {
    "identifiers": {
        "schema_keys": ["identifiers"],
        "search_headers": ["CUSIP", "ISIN", "VALOREN", "WKN", "PRODUCT NAME", "SECURITY NAME",
                           "PRICING SUPPLEMENT", "PROSPECTUS SUPPLEMENT"],
        "max_chars": 8000},
    "product_generic": {
        "schema_keys": ["structuredProductsGeneric", "funding"],
        "search_headers": ["ISSUE DATE", "PRICING DATE", "MATURITY DATE",
                           "FINAL VALUATION DATE", "DENOMINATION",
                           "AGGREGATE PRINCIPAL AMOUNT", "ISSUE PRICE", "ORIGINAL ISSUE DATE",
                           "TRADE DATE", "INITIAL PAYMENT DATE", "SUBSCRIPTION", "SETTLEMENT",
                           "INSTRUMENT CURRENCY", "PAYMENT AT MATURITY", "REDEMPTION AMOUNT",
                           "PAYOUT", "PAYMENT UPON MATURITY", "CALCULATION OF PAYMENT"],
        "max_chars": 15000},
    "underlying_terms": {
        "schema_keys": ["underlyingTerms", "underlyings"],
        "search_headers": ["UNDERLYING", "BASKET", "INDEX COMPONENT", "INITIAL LEVEL",
                           "INITIAL CLOSING LEVEL", "INITIAL VALUATION DATE",
                           "FINAL VALUATION DATE", "OBSERVATION DATE", "REFERENCE ASSET",
                           "LINKED TO", "REFERENCE INDEX", "REFERENCE STOCK"],
        "max_chars": 12000},
    "protection": {
        "schema_keys": ["barrier", "downsideRisk"],
        "search_headers": ["BARRIER", "TRIGGER", "KNOCK-IN", "KNOCK IN", "TRIGGER LEVEL",
                           "BARRIER LEVEL", "DOWNSIDE THRESHOLD", "PROTECTION LEVEL",
                           "CONTINGENT PROTECTION", "CAPITAL AT RISK", "BUFFER",
                           "BUFFER LEVEL", "BUFFER AMOUNT", "SOFT PROTECTION",
                           "PARTIAL PROTECTION", "STRIKE", "INITIAL LEVEL", "DOWNSIDE RISK"],
        "max_chars": 10000},
    "autocall": {
        "schema_keys": ["autocall"],
        "search_headers": ["AUTOCALL", "AUTO CALL", "AUTOMATIC REDEMPTION", "AUTOMATIC CALL",
                           "EARLY REDEMPTION", "CALL DATE", "CALL LEVEL", "OBSERVATION DATE",
                           "MEMORY COUPON", "ISSUER CALL", "OPTIONAL REDEMPTION",
                           "OPTIONAL REDEMPTION DATES", "ISSUER'S OPTION",
                           "REDEMPTION AT THE OPTION", "AUTOCALLABLE"],
        "max_chars": 10000},
    "coupon": {
        "schema_keys": ["coupon"],
        "search_headers": ["COUPON", "CONTINGENT INTEREST", "CONDITIONAL COUPON",
                           "INTEREST RATE", "COUPON BARRIER", "INTEREST BARRIER",
                           "PAYMENT DATE", "INTEREST PAYMENT", "CONTINGENT COUPON RATE",
                           "COUPON OBSERVATION", "FIXED RATE", "COUPON FREQUENCY",
                           "DAY COUNT", "ACCRUAL"],
        "max_chars": 10000},
    "parties": {
        "schema_keys": ["parties"],
        "search_headers": ["ISSUER", "GUARANTOR", "CALCULATION AGENT", "MARKET MAKER",
                           "SELLING AGENT", "PAYING AGENT", "LEGAL ENTITY IDENTIFIER", "LEI",
                           "COUNTERPARTY", "TRUSTEE"],
        "max_chars": 8000},
}

# ---- fixed values: issuers in file order, with name patterns and section headings --------
ISSUERS = [
    {"issuer_key": "Bank of Montreal",
     "patterns": ["Bank of Montreal", "BANK OF MONTREAL", "BMO"],
     "headings": ["Terms of the Notes:", "Specific Terms of the Notes:",
                  "Key Terms of the Notes:", "Additional Terms of the Notes",
                  "Selected Risk Considerations"],
     "table_heading": "Specific Terms of the Notes:"},
    {"issuer_key": "Barclays Bank PLC",
     "patterns": ["Barclays Bank PLC", "BARCLAYS BANK PLC", "Barclays"],
     "headings": ["KEY TERMS", "Payment at Maturity", "Automatic Redemption",
                  "Coupon Barrier Value", "Redemption Premium"],
     "table_heading": "KEY TERMS"},
    {"issuer_key": "BofA Finance LLC",
     "patterns": ["BofA Finance", "Bank of America", "BOFA"],
     "headings": ["Terms of the Notes",
                  "Observation Dates, Contingent Payment Dates and Call Payment Dates",
                  "Contingent Coupon Payment and Redemption Amount Determination"],
     "table_heading": "Terms of the Notes"},
    {"issuer_key": "Citigroup Inc",
     "patterns": ["Citigroup Inc", "CITIGROUP INC", "Citigroup", "Citi"],
     "headings": ["KEY TERMS", "Payment at maturity", "Contingent coupon payment dates",
                  "Potential redemption dates", "Underlying"],
     "table_heading": "KEY TERMS"},
    {"issuer_key": "GS Finance Corp",
     "patterns": ["Goldman Sachs", "GS Finance Corp", "GOLDMAN SACHS GROUP"],
     "headings": ["Key Terms and Assumptions", "Summary", "Hypothetical Coupon Payments",
                  "Terms of Your Notes"],
     "table_heading": "Key Terms and Assumptions"},
    {"issuer_key": "JPMorgan Chase & Co",
     "patterns": ["JPMorgan Chase & Co", "JPMORGAN CHASE & CO", "JP Morgan Chase"],
     "headings": ["Key Terms",
                  "Key Terms Relating to the Review Dates and Interest Payment Dates",
                  "Payment at Maturity If the Notes Have Not Been Automatically Called",
                  "Automatic Call", "Total Contingent Interest Payments",
                  "Supplemental Terms of the Notes"],
     "table_heading": "Key Terms"},
    {"issuer_key": "JPMorgan Chase Financial Company LLC",
     "patterns": ["JPMorgan Chase Financial", "JPMORGAN CHASE", "JPMorgan Chase & Co"],
     "headings": ["Key Terms",
                  "Key Terms Relating to the Review Dates and Interest Payment Dates",
                  "Supplemental Terms of the Notes",
                  "Payments in Connection with the First Review Date"],
     "table_heading": "Key Terms"},
    {"issuer_key": "UBS AG",
     "patterns": ["UBS AG", "UBS Securities"],
     "headings": ["Investment Description", "Features", "Key Dates", "Note Offering",
                  "Preliminary Terms", "Key Risks"],
     "table_heading": "Note Offering"},
    {"issuer_key": "Wells Fargo & Company",
     "patterns": ["Wells Fargo & Company", "WELLS FARGO & COMPANY/MN", "Wells Fargo"],
     "headings": ["Payment at Maturity", "Optional Redemption", "Optional Redemption Dates",
                  "Interest"],
     "table_heading": "Terms of the Notes"},
]

# ---- fixed values: pipeline step labels --------------------------------------------------
STEP_LABELS = {
    "classify_stage1": "Classify — stage 1",
    "classify_stage2": "Classify — stage 2 (fallback overhead)",
    "extract": "Extract — single call",
    "extract_identifiers": "Extract — identifiers",
    "extract_product_generic": "Extract — product generic",
    "extract_underlying_terms": "Extract — underlying terms",
    "extract_protection": "Extract — protection / barrier",
    "extract_autocall": "Extract — autocall",
    "extract_coupon": "Extract — coupon",
    "extract_parties": "Extract — parties",
}

# ---- fixed values: log levels by rank ----------------------------------------------------
LOG_LEVELS = {"DEBUG": 0, "INFO": 1, "WARNING": 2, "ERROR": 3, "CRITICAL": 4}

# ---- fixed values: review and lifecycle states -------------------------------------------
SCHEMA_VIOLATION = "Schema violation: '"
SCHEMA_ALLOWED = "' is not a valid value. Allowed: ["
NO_RESULTS = "No extraction results found"
EXPORT_BLOCKED = "Export blocked — required fields are null: "
CONFIRM_REASON = "human confirmation via classification review gate"
OVERRIDE_REASON = "manual override via UI"
DONE_STATES = ["extracted", "approved", "exported"]
FILING_STATES = ["ingested", "classified", "needs_classification_review", "needs_review", "extracting", *DONE_STATES]


def shared_label_rows():
    """(label, field_path) rows of the shared label map."""
    return [(label, path) for path, labels in SHARED_LABELS.items() for label in labels]

# ---- coupon schedules (O9); defaults that callers may replace ------------------------------

#: Code of a frequency: unit of its step, and how many.
SCHEDULE_FREQUENCIES = {"daily": ("day", 1), "weekly": ("day", 7), "monthly": ("month", 1), "quarterly": ("month", 3), "semiannual": ("month", 6), "annual": ("month", 12)}

#: Spellings of conventions, in lower case, and their codes.
SCHEDULE_SPELLINGS = {
    "daily": "daily", "weekly": "weekly", "monthly": "monthly", "every month": "monthly", "quarterly": "quarterly", "every three months": "quarterly",
    "semi-annual": "semiannual", "semi-annually": "semiannual", "semiannual": "semiannual", "semiannually": "semiannual", "annual": "annual", "annually": "annual",
    "per annum": "annual", "act/360": "act/360", "actual/360": "act/360", "act/365": "act/365", "actual/365": "act/365", "30/360": "30/360",
    "act/act": "act/act", "actual/actual": "act/act", "following": "following", "following business day": "following",
    "following business day convention": "following", "modified following": "modified", "modified following business day convention": "modified",
    "preceding": "preceding", "preceding business day convention": "preceding", "unadjusted": "unadjusted",
}
