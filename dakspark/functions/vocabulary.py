"""Small word lists of the domain; callers may pass their own to every function that uses one."""

# Names and terms of Indian addresses.
CITIES = (
    "ahmedabad", "bangalore", "bhopal", "chandigarh", "chennai", "coimbatore", "delhi", "gurgaon", "hyderabad",
    "indore", "jaipur", "kochi", "kolkata", "lucknow", "mumbai", "mysore", "nagpur", "noida", "patna", "pune",
    "surat", "thane", "vadodara", "visakhapatnam",
)
STATES = (
    "andhra pradesh", "assam", "bihar", "delhi", "goa", "gujarat", "haryana", "karnataka", "kerala",
    "madhya pradesh", "maharashtra", "odisha", "punjab", "rajasthan", "tamil nadu", "telangana", "uttar pradesh",
    "west bengal",
)
CITY_STATE = {
    "ahmedabad": "gujarat", "bangalore": "karnataka", "bhopal": "madhya pradesh", "chennai": "tamil nadu",
    "coimbatore": "tamil nadu", "delhi": "delhi", "gurgaon": "haryana", "hyderabad": "telangana",
    "indore": "madhya pradesh", "jaipur": "rajasthan", "kochi": "kerala", "kolkata": "west bengal",
    "lucknow": "uttar pradesh", "mumbai": "maharashtra", "mysore": "karnataka", "nagpur": "maharashtra",
    "noida": "uttar pradesh", "patna": "bihar", "pune": "maharashtra", "surat": "gujarat", "thane": "maharashtra",
}
CITY_ALIASES = {
    "bengaluru": "bangalore", "bombay": "mumbai", "madras": "chennai", "calcutta": "kolkata", "blr": "bangalore",
    "gurugram": "gurgaon", "hyd": "hyderabad", "mysuru": "mysore", "cochin": "kochi", "poona": "pune",
}
ABBREVIATIONS = {
    "rd": "road", "st": "street", "ln": "lane", "apt": "apartment", "blk": "block", "nr": "near", "opp": "opposite",
    "flr": "floor", "bldg": "building", "soc": "society",
}
ROAD_WORDS = ("road", "street", "lane", "marg", "path", "avenue", "salai", "highway", "main", "cross")
LOCALITY_WORDS = ("layout", "nagar", "colony", "extension", "town", "puram", "pura", "halli", "garden", "gardens", "ward")
SUB_ANCHOR_WORDS = ("block", "phase", "sector", "stage", "cross", "main")
STOP_WORDS = (
    "and", "at", "behind", "beside", "building", "flat", "floor", "for", "from", "house", "india", "in", "near",
    "next", "no", "of", "on", "opposite", "plot", "the", "to",
)
BUILDING_WORDS = ("apartment", "apartments", "tower", "towers", "residency", "complex", "plaza", "heights", "enclave")
GENERIC_BRANDS = ("the", "new", "old", "main", "near", "behind", "opposite", "royal", "green", "city", "grand")
# Usual misspellings.
MISSPELLINGS = {
    "raod": "road", "rood": "road", "stret": "street", "streat": "street", "nagr": "nagar", "layot": "layout",
    "lyout": "layout", "colny": "colony", "apartmnt": "apartment", "banglore": "bangalore", "bengalore": "bangalore",
    "mumbi": "mumbai", "chenai": "chennai", "delli": "delhi", "kolkatta": "kolkata", "hydrabad": "hyderabad",
    "opposit": "opposite", "bilding": "building", "flour": "floor", "blok": "block",
}
# Phrases of one to four tokens with their usual form.
LOCALITY_ALIASES = {
    "btm": "btm layout", "hsr": "hsr layout", "mg road": "mahatma gandhi road", "m g road": "mahatma gandhi road",
    "jp nagar": "jayaprakash nagar", "j p nagar": "jayaprakash nagar", "cv raman nagar": "c v raman nagar",
    "ecity": "electronic city", "e city": "electronic city", "indira nagar": "indiranagar",
    "white field": "whitefield", "kora mangala": "koramangala",
}
# Replacements of the phonetic hash, in order; then runs of a vowel.
PHONETIC_RULES = (
    ("ph", "f"), ("sh", "s"), ("sz", "s"), ("ch", "c"), ("gh", "g"), ("kh", "k"), ("jh", "j"), ("th", "t"),
    ("dh", "d"), ("bh", "b"), ("x", "ks"), ("z", "j"), ("q", "k"),
)
PHONETIC_RUNS = (("ee+", "i"), ("oo+", "u"), ("aa+", "a"))
# The neighbours of each key.
KEYBOARD = {
    "q": "wa", "w": "qase", "e": "wsdf", "r": "edfg", "t": "rfgh", "y": "tghj", "u": "yhjki", "i": "ujklo", "o": "iklp",
    "p": "ol", "a": "qwsz", "s": "awdezx", "d": "serfcx", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "j": "huikmn",
    "k": "jiolm", "l": "kop", "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb", "b": "vghn", "n": "bhjm", "m": "njk",
}
# The precision of a geocoder's kinds of place.
PRECISION = {"ROOFTOP": 1.0, "RANGE_INTERPOLATED": 0.85, "GEOMETRIC_CENTER": 0.65, "APPROXIMATE": 0.45}
