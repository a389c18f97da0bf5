"""Word lists that decide what is a name, a place or an institution.

Fixed values: results depend on exactly these words, phrases and constants."""

# Public bodies; they identify nobody and stay unless a policy says otherwise.
INSTITUTIONS = frozenset([
    "securities and exchange board of india", "sebi", "reserve bank of india", "rbi", "registrar of companies", "roc",
    "ministry of corporate affairs", "mca", "government of india", "central government", "state government",
    "income tax department", "national company law tribunal", "nclt", "supreme court", "high court",
    "insurance regulatory and development authority", "irdai", "competition commission of india",
    "directorate general of foreign trade", "customs", "gst council", "central board of direct taxes",
    "employees provident fund organisation", "ministry of finance", "niti aayog", "united nations", "world bank",
    "international monetary fund", "world trade organization", "european union", "bse limited", "bse",
    "national stock exchange of india limited", "nse", "stock exchanges", "stock exchange", "nsdl", "cdsl",
    "national securities depository limited", "central depository services (india) limited", "clearing corporation",
    "indian clearing corporation limited", "institute of chartered accountants of india", "icai",
    "institute of company secretaries of india", "icsi", "bureau of indian standards", "iso", "crisil ratings",
    "care ratings",
])

# Endings that mark a company, trust or family vehicle.
LEGAL_SUFFIXES = (
    "Limited", "Ltd", "Ltd.", "Private Limited", "Pvt. Ltd.", "Pvt Ltd", "LLP", "Inc", "Inc.", "Incorporated",
    "Corporation", "Corp", "Corp.", "GmbH", "B.V.", "N.V.", "PLC", "S.A.", "Pte", "Pte. Ltd.", "LLC", "L.L.C.", "LP",
    "AB", "AG", "A/S", "Oy", "SpA", "S.p.A.", "SAS", "Pty", "Pty Ltd", "Sdn Bhd", "Chartered Accountants",
    "& Associates", "& Sons", "Trust", "Foundation", "HUF",
)

# Words that no person's name holds.
NOT_IN_NAMES = frozenset([
    "board", "company", "offer", "issuer", "promoter", "promoters", "director", "directors", "shareholder",
    "shareholders", "equity", "share", "shares", "bidder", "bidders", "allottee", "registrar", "auditor", "auditors",
    "chapter", "section", "schedule", "annexure", "regulation", "regulations", "act", "rules", "circular",
    "notification", "prospectus", "draft", "red herring prospectus", "book running lead managers", "anchor investor",
    "state", "india", "bharat", "rupees", "million", "crore", "lakh", "january", "february", "march", "april", "may",
    "june", "july", "august", "september", "october", "november", "december", "fiscal", "financial year", "gst",
    "pan", "din", "cin", "upi", "asba", "ipo", "nav", "ebitda",
])

# Capitalised vocabulary that documents of this kind define for themselves.
DEFINED_TERMS = frozenset([
    "asba", "asba account", "asba form", "asba forms", "allotment", "allotted", "allottee", "allottees",
    "anchor investor", "anchor investors", "bid", "bids", "bidder", "bidders", "bid amount", "bid lot", "bidding",
    "book building process", "book running lead manager", "book running lead managers", "basis of allotment",
    "cap price", "floor price", "price band", "cut-off price", "offer price", "draft red herring prospectus",
    "red herring prospectus", "prospectus", "equity share", "equity shares", "equity share capital",
    "preference shares", "board of directors", "board", "audit committee", "ipo committee",
    "nomination and remuneration committee", "stakeholders relationship committee",
    "corporate social responsibility committee", "risk management committee", "bonus issue", "fresh issue",
    "offer for sale", "net offer", "net proceeds", "general information document", "abridged prospectus",
    "bid cum application form", "designated intermediaries", "designated date", "designated stock exchange",
    "escrow account", "public offer account", "refund account", "sponsor bank", "self certified syndicate bank",
    "syndicate member", "syndicate members", "registrar to the offer", "registrar agreement",
    "underwriting agreement", "working day", "fiscal", "fiscals", "financial year", "restated financial information",
    "ebitda", "ebit", "cogs", "nav", "ronw", "eps", "pat", "gst", "ipo", "upi", "cin", "din", "pan", "dp id",
    "client id", "upi id", "upi mandate", "isin", "nach", "rtgs", "neft", "ifrs", "ind as", "us gaap", "femas",
    "fema", "fpi", "fii", "qib", "qibs", "hni", "nri", "nris", "oci", "rii", "hufs", "huf", "mutual funds",
    "insurance companies", "corporate office", "registered office", "compliance officer", "company secretary",
    "chief executive officer", "chief financial officer", "managing director", "independent director",
    "independent directors", "executive director", "whole-time director", "key managerial personnel",
    "senior management", "promoter", "promoters", "promoter group", "promoter selling shareholders",
    "group companies", "material subsidiary", "subsidiaries", "joint venture", "related party", "related parties",
    "statutory auditors", "peer review", "chartered accountants", "memorandum of association",
    "articles of association", "companies act", "sebi icdr regulations", "sebi listing regulations",
    "stock exchanges", "depositories", "depository participant", "continuous transposed conductors",
    "capital market division", "investment", "hindi", "english", "marathi", "india", "bharat", "green shoe option",
    "green shoe", "diesel generators", "diesel generator", "air conditioning", "air conditioner", "mega volt-amperes",
    "mega volt", "kilovolt", "kilovolts", "volt-amperes", "megawatt", "megawatts",
    "institute of chartered accountants", "refund bank", "specified locations", "united states dollars",
    "sponsor banks", "escrow bank", "public offer", "offer agreement", "share escrow agent", "monitoring agency",
    "red herring", "private limited", "securities", "registrar", "syndicate", "branch", "branches", "department",
    "research", "trust", "locations", "facility", "scsb", "scsbs", "npci",
])

STATES = frozenset([
    "maharashtra", "karnataka", "gujarat", "tamil nadu", "telangana", "kerala", "delhi", "haryana", "punjab",
    "rajasthan", "uttar pradesh", "madhya pradesh", "west bengal", "bihar", "odisha", "andhra pradesh", "goa",
    "assam", "jharkhand", "chhattisgarh", "uttarakhand", "himachal pradesh", "jammu and kashmir",
])

# Places too large to identify anybody, and further countries and nationalities.
OPEN_PLACES = frozenset([
    "india", "bharat", "asia", "europe", "africa", "america", "north america", "south america", "australia", "china",
    "japan", "usa", "united states", "united kingdom", "uk", "us", "germany", "france", "italy", "spain", "singapore",
    "dubai", "uae", "middle east", "far east", "european union",
])
COUNTRIES = frozenset([
    "sweden", "norway", "denmark", "finland", "netherlands", "belgium", "switzerland", "austria", "poland", "portugal", "greece", "turkey", "russia", "ukraine",
    "canada", "mexico", "brazil", "argentina", "chile", "south africa", "egypt", "nigeria", "kenya", "israel",
    "saudi arabia", "qatar", "kuwait", "oman", "bahrain", "iran", "iraq", "pakistan", "bangladesh", "sri lanka",
    "nepal", "bhutan", "myanmar", "thailand", "vietnam", "malaysia", "indonesia", "philippines", "south korea",
    "korea", "taiwan", "hong kong", "new zealand", "ireland", "scotland", "wales", "united states of america", "u.s.",
    "u.s.a.", "america", "european", "american", "chinese", "japanese", "german", "british", "indian",
])

# Words of an address that are no places.
PLACE_NOISE = frozenset([
    "village", "taluka", "tehsil", "district", "dist", "post", "near", "off", "opposite", "behind", "road", "marg",
    "street", "lane", "chowk", "phase", "plot", "gat", "survey", "floor", "wing", "tower", "block", "sector",
    "building", "premises", "compound", "estate", "industrial", "area", "park", "no", "nos", "and", "the", "at", "of",
    "state", "country", "pin", "pincode",
])

# Words that make a line look like an address.
ADDRESS_HINTS = frozenset([
    "road", "rd", "street", "st", "marg", "lane", "nagar", "colony", "society", "sector", "block", "tower",
    "building", "bldg", "floor", "flat", "plot", "gat", "survey", "village", "taluka", "tehsil", "district", "dist",
    "po", "opposite", "near", "behind", "chowk", "cross", "phase", "industrial", "estate", "mida", "midc", "gidc",
    "apartment", "apartments", "bunglow", "bungalow", "house", "complex", "park", "avenue", "boulevard", "drive",
    "highway", "wing", "annexe", "premises", "compound", "layout", "s. no", "p.o",
])
ADDRESS_TAILS = STATES | {"india", "usa", "united states", "uk", "singapore", "germany"}

# What a company pattern picks up in front of a name, and words that are no company.
ORG_LEAD_NOISE = frozenset([
    "the", "our", "of", "and", "by", "to", "for", "with", "at", "in", "from", "being", "formerly", "registered",
    "corporate", "office", "company", "escrow", "collection", "designated", "statutory", "namely", "erstwhile",
])
GENERIC_ORGS = frozenset([
    "the company", "our company", "company", "the issuer", "issuer", "the offer", "group companies", "subsidiary",
    "subsidiaries", "the board", "board", "promoter group", "the promoters", "our promoters", "the bank", "banks",
    "government", "the group",
])

TLDS = [
    "com", "net", "org", "edu", "gov", "info", "biz", "io", "co", "in", "uk", "us", "ai", "app", "dev", "me", "tv",
    "asia", "eu",
]
SECOND_LEVELS = [
    "in", "uk", "us", "au", "nz", "za",
]

# Mailboxes of a function, and hosts of free mail.
ROLE_MAILBOXES = frozenset([
    "info", "support", "contact", "sales", "admin", "office", "help", "helpdesk", "care", "customercare",
    "customerservice", "service", "grievance", "grievances", "investor", "investors", "ipo", "cs", "compliance",
    "secretary", "hr", "careers", "legal", "finance", "accounts", "billing", "noreply", "no-reply", "mail", "enquiry",
    "enquiries", "team", "corp", "pro", "connect", "in",
])
FREE_MAIL = frozenset([
    "gmail.com", "yahoo.com", "yahoo.co.in", "hotmail.com", "outlook.com", "rediffmail.com", "aol.com", "icloud.com",
    "protonmail.com",
])

# Captions of a signature, and the shape of handwriting.
SIGNATURE_CUES = (
    "signature", "signed by", "sd/-", "sd/", "authorised signatory", "authorized signatory", "for and on behalf of",
    "specimen signature", "in witness whereof", "yours faithfully", "yours sincerely", "thumb impression", "initials",
)
SIGNATURE_INK = {"min_ink": 0.004, "max_ink": 0.35, "max_saturation": 60.0, "max_stroke": 0.06, "min_aspect": 0.8}
MIN_IMAGE_SIDE = 32
MAX_OCR_SIDE = 1600

# Our own pools of invented names; none is a real state, town or surname list.
ORG_HEADS = [
    "Alderway", "Brightforge", "Cindermoor", "Dovetail", "Embercrest", "Foxmere", "Galewick", "Hartwell", "Islewood",
    "Jadeport", "Knollview", "Lanternby", "Mossgate", "Nettlebrook", "Orrinvale", "Palecrest", "Quillstone",
    "Ravenhurst", "Saltmarsh", "Tidewell", "Underhill", "Vellum", "Wrenfield", "Yonderly", "Zephyrine",
]
ORG_TAILS = [
    "Logistics", "Textiles", "Instruments", "Provisions", "Analytics", "Freight", "Ceramics", "Optics", "Foundry",
    "Mills", "Outfitters", "Labs",
]
FIRST_NAMES = [
    "Adan", "Brielle", "Corwin", "Delphine", "Emeric", "Fenna", "Galen", "Hollis", "Isolde", "Jorah", "Kestra",
    "Lorcan", "Maren", "Nerys", "Orin", "Petra", "Quillan", "Rosalind", "Soren", "Tamsin", "Ulric", "Vesper",
    "Wystan", "Yara", "Zelda",
]
SURNAMES = [
    "Ambergate", "Blackmere", "Coldwater", "Dunmarsh", "Eastlake", "Farrowby", "Greyling", "Hollowell", "Inglewood",
    "Jessamy", "Kirkwell", "Lindqvist", "Marchbank", "Northwood", "Oakhurst", "Penhallow", "Quickfall", "Ravenscar",
    "Stonebridge", "Thistlewood", "Underwood", "Vantage", "Westerby", "Yewdale",
]
STREETS = [
    "Amberley", "Bramblewick", "Cloverleaf", "Dapplegate", "Elderflower", "Foxglove", "Gorsefield", "Heatherside",
    "Ivyhouse", "Juniper", "Kingfisher", "Lavender", "Meadowsweet", "Nutmeg", "Osier", "Pimpernel", "Quince",
    "Rosehip",
]
LOCALITIES = [
    "Aldmoor", "Birchhaven", "Calderby", "Deepwell", "Elmsworth", "Fernhollow", "Glenmarch", "Hazelford", "Ivorymere",
    "Larkmoor", "Mistvale", "Oxbridge",
]
PLACE_TAILS = [
    "Bend", "Cliff", "Copse", "Crossing", "Down", "Ford", "Glen", "Grove", "Hythe", "Lea", "Mere", "Mount", "Rise",
    "Spring", "Water", "Weir",
]
REGIONS = ("Ostmark Region", "Veldtshire", "Norrland Province", "Sundale Region", "Highmere", "Brackenshire")
