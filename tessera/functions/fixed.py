"""Patterns, word lists and thresholds that results depend on, stated once."""

# --- Fixed values: identity of designations ------------------------------------------------------------------------
#: A citation, and the phrases that name nothing although a number may follow them.
GENERIC = r"(?<!\brelevant )(?<!\bapplicable )(?<!\brespective )(?<!\bappropriate )(?<!\bany other )"
CITATION = r"(?<![A-Za-z])IS(?:/(?:IEC|ISO))?(?![A-Za-z])[:\s]*(\d{2,})(?:\s*\(([^)]{0,40})\))?"
#: What a reader may take for one, and a number with a year stuck to it.
LOOSE = r"(?i)\bIS[:\s]*(\d{2,6})(?:\s*\([^)]{0,40}\))?(?:\s*[:\-]\s*((?:19|20)\d{2}))?"
GLUED = r"^(\d{2,6})((?:19|20)\d{2})$"
#: Designations of adopted texts carry a second prefix.
PREFIX = r"IS(?:/(?:IEC|ISO))?"
DUAL = r"\s*/\s*(?:ISO|IEC|EN|BS|ASTM|DIN|JIS)\b.*$"
TRAILING_PART = r"(?i)[\s,:;/-]*\b(?:Parts?|Pt\.?|Sections?|Sec\.?)\b.*$"
EDITION = r":\s*(?:19|20)\d{2}\s*$"
TRAILING_JUNK = r"[\s*+#†‡.,;:/-]+$"
MOST_DIGITS = 6
PART_TOKEN = r"(?i)part\s*([0-9ivx]+)|sec(?:tion)?\s*([0-9ivx]+)"
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
#: Numbers from here on are adopted texts, published under the second prefix.
ADOPTED_FROM = 60000
FOREIGN = r"\b(?:IEC|ISO|ASTM|BS\s?EN|BS|DIN|EN|IEEE|ANSI)\s*[:\-]?\s*\d{2,6}(?:[-\s]?\d+)?\b"

# --- Fixed values: statuses and populations ------------------------------------------------------------------------
DEAD = ["Superseded", "Withdrawn"]
EVIDENCE = ["Usable", "Read by OCR"]
TEXT_LAYER = ["Usable"]
BLANK = ["", "n/a", "nan", "none", "unknown", "null"]

# --- Fixed values: thresholds --------------------------------------------------------------------------------------
HIGH_BAND, MEDIUM_BAND = 0.65, 0.40
RRF_K, FUSE_DEPTH, SHORTLIST = 60, 20, 10
TOP_SCORE, MARGIN, HIGH_CONFIDENCE = 0.45, 0.10, 0.80
FUSED_MIDPOINT, FUSED_GAIN = 0.55, 12.0
LEXICAL_SCALE, LEXICAL_GAIN = 14.0, 4.0
DENSE_MIDPOINT, DENSE_GAIN = 0.81, 12.0
EXPAND_FROM, EXPAND_EACH = 3, 5
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
EDGE_CAP = 12
MISSING_CONFIDENCE, MISSING_COUNT, MISSING_EACH, MISSING_ALL = 0.55, 8, 3, 8
MISSING_WIDTH = 4
NORMATIVE = 0.75
SUCCESSOR_SCORE = 0.45
BUYER_FLOOR = 10
PEER_DEPTH, PEER_SHARE, PEER_LEAST = 30, 0.35, 3
SHINGLE, PERMUTATIONS, BANDS, LEAST_SHINGLES, JACCARD, SEED = 5, 128, 32, 40, 0.80, 17
SWEEP = [0.8, 0.65, 0.5, 0.35]
SEPARATION_STEPS, SEPARATION_RADIUS, SEPARATION_PUSH, TIE_NOISE = 120, 0.90, 0.08, 0.006
LEAST_LENGTH = 0.55
MATCHES = 5
NORMATIVE_MOST = 6
QUERY_CHARS = 2000
NOTIFICATION_CHARS = 180
BAND_FRACTION, BAND_GAP, BAND_LINES = 0.30, 1.6, 8
BANNER_TOP, BANNER_WIDTH, BANNER_LEAST = 2, 0.8, 8
CACHE_SECONDS, CACHE_ENTRIES = 1800, 24
PAGE_CHARS = 300_000
UNSEEN = ["script", "style", "noscript", "textarea"]
#: Bytes of an upload, characters of a text, strings of a request, characters of a text to repair.
UPLOAD_BYTES, TEXT_CHARS, STRINGS, REPAIR_CHARS = 25 * 1024 * 1024, 400_000, 600, 18_000
SHRINK = 0.20

# --- Fixed values: certification demand ----------------------------------------------------------------------------
MARK = [
    r"standard\s*mark",
    r"\bISI\s*mark",
    r"certification\s+mark",
    r"BIS\s*(certifi|registrat|licen|mark)",
    r"\bCM\s*/\s*L\b",
    r"licen[cs]e\s+(no|number)",
    r"certified\s+under\s+.{0,30}BIS",
    r"shall\s+be\s+certified",
    r"\bQCO\b",
    r"quality\s+control\s+order",
]
#: For each of these patterns a word, in lower case, that every match has.
MARK_WORDS = ["mark", "isi", "mark", "bis", "cm", "licen", "certified", "certified", "qco", "quality"]

# --- Fixed values: roles of a title, first match wins --------------------------------------------------------------
ROLES = [
    ("test_method", "Test method", [r"\bmethods?\s+of\s+test\b", r"\btest\s+methods?\b", r"\btesting\s+of\b", r"\bmethods?\s+for\s+(?:sampling|determination|measurement|test)", r"\bsampling\b"]),
    ("terminology", "Terminology", [r"\bglossary\b", r"\bterminolog", r"\bdefinitions?\b", r"\bvocabulary\b", r"\bnomenclature\b", r"\bletter\s+symbols\b"]),
    ("installation", "Installation and practice", [r"\bcode\s+of\s+practice\b", r"\binstallation\b", r"\berection\b", r"\blaying\b", r"\bmaintenance\b", r"\brecommendations?\s+for\b", r"\bguide\s+for\b", r"\bguidelines?\s+for\b"]),
    ("safety", "Safety", [r"\bsafety\b", r"\bprotection\s+against\b", r"\bhazard", r"\bfire\s+resist", r"\bflammabilit", r"\bexplosive\s+atmospher"]),
    ("dimensions", "Dimensions and ratings", [r"\bdimensions?\b", r"\bsizes\b", r"\bcurrent\s+ratings?\b", r"\bpreferred\s+numbers\b", r"\btolerances?\b"]),
    ("quality_system", "Quality and conformity", [r"\bquality\s+(?:management|assurance|system)", r"\bconformity\s+assessment\b", r"\binspection\b", r"\bacceptance\b"]),
]
OTHER_ROLE = ("product", "Related product standard")
#: Words of a query that ask for a kind of document.
ROLE_SEEKING = {
    "test_method": [r"\bmethod of test\b", r"\btest method\b", r"\btesting\b", r"\bsampling\b"],
    "installation": [r"\bcode of practice\b", r"\binstallation\b", r"\blaying\b", r"\berection\b", r"\bmaintenance\b"],
    "terminology": [r"\bglossary\b", r"\bterminolog", r"\bdefinitions?\b"],
    "safety": [r"\bsafety requirements?\b"],
}
#: Roles that are never the specification of a product.
NOT_PRODUCT = ["terminology", "installation"]

# --- Fixed values: materials and the pairs that agree --------------------------------------------------------------
MATERIALS = {
    "cpvc": [r"\bCPVC\b", r"chlorinated\s+poly"],
    "upvc": [r"\bU-?PVC\b", r"\bPVC-?U\b", r"unplastici[sz]ed"],
    "pvc": [r"\bPVC\b", r"polyvinyl\s+chloride"],
    "xlpe": [r"\bXLPE\b", r"cross-?\s?linked\s+polyethylene"],
    "hdpe": [r"\bHDPE\b", r"high\s+density\s+polyethylene"],
    "ldpe": [r"\bLDPE\b", r"low\s+density\s+polyethylene"],
    "grp": [r"\bGRP\b", r"\bFRP\b", r"glass-?\s?fibre\s+reinforced"],
    "concrete": [r"\bconcrete\b", r"\bcement\s+concrete\b"],
    "asbestos": [r"\basbestos\b"],
    "cast_iron": [r"\bcast\s+iron\b", r"\bCI\b"],
    "ductile_iron": [r"\bductile\s+iron\b"],
    "steel": [r"\bgalvani[sz]ed\b", r"\bsteel\s+tube", r"\bmild\s+steel\b", r"\bGI\b"],
    "elastomer": [r"\belastomer\b", r"\brubber\b"],
}
AGREE = [("pvc", "upvc"), ("upvc", "pvc"), ("pvc", "cpvc"), ("cpvc", "pvc")]

# --- Fixed values: query expansions --------------------------------------------------------------------------------
EXPANSIONS = {
    "xlpe": "cross-linked polyethylene",
    "upvc": "unplasticized polyvinyl chloride",
    "pvc-u": "unplasticized polyvinyl chloride",
    "hdpe": "high density polyethylene",
    "ldpe": "low density polyethylene",
    "acsr": "aluminium conductor steel reinforced",
    "frp": "fibre reinforced plastic",
    "rcc": "precast concrete",
    "gi": "galvanized steel tubes tubulars wrought steel fittings",
    "led": "light emitting diode",
    "lt": "low voltage",
    "ht": "high voltage",
}
STRICT_EXPANSIONS = {"MS": "mild steel", "CI": "cast iron", "DI": "ductile iron", "IP": "degrees of protection", "ABC": "aerial bunched"}
PHRASES = {
    r"\breinforced\s+cement\s+concrete\b|\bcement\s+concrete\b": "precast concrete",
    r"\bgalvani[sz]ed\s+(?:iron|steel)\b": "galvanized steel tubes tubulars wrought steel fittings",
    r"\bstreet\s+light(?:ing)?\b": "road and street lighting luminaires",
    r"\bflood\s+light\b": "floodlight luminaire",
    r"\bearthing\b": "earthing and bonding",
    r"\bpotable\b": "drinking water supplies",
    r"\bdrinking\s+water\b": "potable water supplies",
}
STOP_TERMS = "a an and as at by for from in into of on or the to with without part sec section is bs iso iec".split()

# --- Fixed values: scripts, by the code points of their blocks -----------------------------------------------------
SCRIPTS = {
    "hi": "ऀ-ॿ",
    "bn": "ঀ-৿",
    "pa": "਀-੿",
    "gu": "઀-૿",
    "or": "଀-୿",
    "ta": "஀-௿",
    "te": "ఀ-౿",
    "kn": "ಀ-೿",
    "ml": "ഀ-ൿ",
    "ur": "؀-ۿ",
}

# --- Fixed values: notifications, bids and service work ------------------------------------------------------------
ORDER_TAIL = r"(?i)\s*(?:Superseded by|Extension in |Order of extension|Extension Order|Order of enforcement|Extension in the date|Subsequent Amendment|Amendment in|Amendments\s*:|Amended by|as amended by|read with)"
MONTH = r"Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t)?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
#: Cells that name an order; rows below without one are under the same.
NOTICE = r"(?i)quality control|order|s\.?o\.?\s*\d|gazette"
SERVICE = r"(?i)\b(service|services|hiring|manpower|consultanc|outsourc|AMC|annual maintenance|repair|housekeeping|security guard|catering|transport|custom bid for services|leasing|rental|printing|training|survey|audit)\b"
PROTECTED = r"(?i)\bIS[:\s/]*\d{2,6}(?:\s*\([^)]{0,40}\))?|\bIS/IEC\s*\d{2,6}|\b(?:\d{1,3}(?:[ ,]\d{3})+|\d+)(?:\.\d+)?\s*(?:kV|V|kW|W|mm|mm2|sqmm|A|Hz|K)\b|\bIP\s?\d{2}\b"
SENTENCE_END = r"(?<=[.;?!])\s+(?=[A-Z{(\"'])"
CATALOGUE_STATUS = {1: "Current", 2: "Current", 3: "Superseded", 4: "Withdrawn"}
DECISIONS = ["accepted", "rejected", "overridden", "escalated"]
LABEL_LINE = r"^\s*/|/\s*$|^[A-Z][A-Za-z() ]{2,45}/\s*\S|^(?:MSE |Minimum |Turnover|Past |Bid |OEM |Consignee|Estimated |Evaluation|Startup |Years |Document|Total )"
VOCABULARY_STOPS = "and for the with from part section specification specifications requirements general method methods test tests other used type types first second third revision amendment code practice glossary terms its their this that such shall into upto including".split()

# --- Fixed values: what generated prose must not say ---------------------------------------------------------------
REFUSAL = r"(?i)^\s*(i (cannot|can't|am unable)|as an ai|sorry|here is|here's|certainly|sure[,.])"
PERMISSIVE = r"(?i)\bnot\s+(?:strictly\s+)?(?:mandatory|compulsory|required|obligatory|binding)\b|\bnon-?mandatory\b|\bmerely\s+advisory\b|\bfor\s+reference\s+only\b|\bdiscretion\b|\boptional\b|\bwhere\s+deemed\s+(?:necessary|appropriate)\b|\bfor\s+reference\b|\bguidance\s+only\b|\bwherever\s+applicable\b|\bencouraged\s+to\b|\bindustry\s+practice\b|\bneed\s+not\s+(?:be|comply)\b"
PARTY = r"(?i)\b(supplier|purchaser|contractor|bidder|tenderer|vendor|department|employer)s?\b[^.]{0,60}?\b(?:shall|must|is\s+required\s+to|are\s+required\s+to)\s+(?:also\s+)?(?:comply|conform|adhere|ensure|review|refer|verify|check)"

# --- Fixed values: words of document names -------------------------------------------------------------------------
ABBREVIATIONS = {
    "nit": "Notice Inviting Tender",
    "niq": "Notice Inviting Quotation",
    "nib": "Notice Inviting Bid",
    "eoi": "Expression of Interest",
    "rfp": "Request for Proposal",
    "boq": "Bill of Quantities",
    "loa": "Letter of Award",
    "lt": "LT",
    "ht": "HT",
    "pvc": "PVC",
    "gi": "GI",
    "led": "LED",
    "rcc": "RCC",
    "hdpe": "HDPE",
    "xlpe": "XLPE",
    "vol": "Volume",
    "sec": "Section",
    "doc": "Document",
    "tenderdoc": "Tender Document",
    "spec": "Specification",
    "tech": "Technical",
    "addendum": "Addendum",
    "corrigendum": "Corrigendum",
}
ALWAYS_UPPER = "LT HT PVC GI LED RCC HDPE XLPE IS BIS II III IV VI VII VIII IX".split()
#: Words of tenders that no title of the register needs to have.
PROCUREMENT_WORDS = (
    "tender tenders document documents notice inviting quotation bid bids bidding enquiry volume part section annexure schedule compliance technical specification specifications "
    "execution works work supply supplies revised revision addendum corrigendum amendment draft final general conditions contract scope estimate quantities civil "
    "electrical mechanical ground floor package division department board corporation council municipal authority project phase zone circle unit open limited global"
).split()
SMALL_WORDS = "and for of the to in with under on at".split()
ORDINAL_OWNERS = ["volume", "part", "section", "vol", "sec", "no"]
GENERIC_TITLES = ["tender document", "document", "tender", "volume", "addendum", "corrigendum", "technical specification", "notice inviting tender", "specification"]
TITLE_SUFFIX = r"(?i)\.(pdf|docx?|xlsx?|zip|pd)$"
TITLE_ID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{6,12}\b"
TITLE_DATE = r"\b20\d{2}[_-]\d{2}[_-]\d{2}([_-]\d{2}){0,3}\b"
TITLE_STAMP = r"\b1[0-9]{9}\b"

# --- Fixed values: lines of documents --------------------------------------------------------------------------------
NUMBERED_HEADING = r"^(\d+(\.\d+)*)[.)]?\s+(.{2,90})$"
GLYPH_MARKS = r"\(cid:\d+\)|[ऀ-ॿ]+"
