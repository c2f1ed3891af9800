"""Fixed values the results depend on: thresholds, word lists and code tables."""

from __future__ import annotations

# --- Fixed values: data releases -------------------------------------------
ARCHIVE_PATTERNS = {
    "foundation_food": r"FoodData_Central_foundation_food_csv_([\d\-]+)\.zip",
    "sr_legacy_food": r"FoodData_Central_sr_legacy_food_csv_([\d\-]+)\.zip",
    "survey_fndds_food": r"FoodData_Central_survey_food_csv_([\d\-]+)\.zip",
}
NEEDED_FILES = (
    "food.csv", "food_attribute.csv", "food_attribute_type.csv", "food_category.csv",
    "food_nutrient.csv", "food_portion.csv", "foundation_food.csv", "input_food.csv",
    "measure_unit.csv", "nutrient.csv", "sr_legacy_food.csv", "survey_fndds_food.csv",
    "wweia_food_category.csv",
)
METADATA_FILES = {
    "foundation_food": "foundation_food.csv",
    "sr_legacy_food": "sr_legacy_food.csv",
    "survey_fndds_food": "survey_fndds_food.csv",
}
FAT_NUTRIENT_ID = 1004

# --- Fixed values: the wide nutrient vector (column -> ids, first present wins)
APP_NUTRIENTS = {
    "energy_kcal": (1008, 2047, 2048),
    "protein_g": (1003,),
    "fat_g": (1004,),
    "carb_g": (1005, 1050),
    "fiber_g": (1079, 2033),
    "sugar_g": (2000, 1063),
    "starch_g": (1009,),
    "water_g": (1051,),
    "ash_g": (1007,),
    "alcohol_g": (1018,),
    "sat_fat_g": (1258,),
    "mono_fat_g": (1292,),
    "poly_fat_g": (1293,),
    "trans_fat_g": (1257,),
    "cholesterol_mg": (1253,),
    "omega3_epa_g": (1278,),
    "omega3_dha_g": (1272,),
    "calcium_mg": (1087,),
    "iron_mg": (1089,),
    "magnesium_mg": (1090,),
    "phosphorus_mg": (1091,),
    "potassium_mg": (1092,),
    "sodium_mg": (1093,),
    "zinc_mg": (1095,),
    "copper_mg": (1098,),
    "manganese_mg": (1101,),
    "selenium_ug": (1103,),
    "fluoride_ug": (1099,),
    "iodine_ug": (1100,),
    "vitamin_a_rae_ug": (1106,),
    "retinol_ug": (1105,),
    "carotene_beta_ug": (1107,),
    "vitamin_c_mg": (1162,),
    "vitamin_d_ug": (1114,),
    "vitamin_e_mg": (1109,),
    "vitamin_k_ug": (1185,),
    "thiamin_mg": (1165,),
    "riboflavin_mg": (1166,),
    "niacin_mg": (1167,),
    "pantothenic_acid_mg": (1170,),
    "vitamin_b6_mg": (1175,),
    "folate_ug": (1177,),
    "folate_dfe_ug": (1190,),
    "vitamin_b12_ug": (1178,),
    "choline_mg": (1180,),
    "biotin_ug": (1176,),
    "caffeine_mg": (1057,),
    "theobromine_mg": (1058,),
    "lycopene_ug": (1122,),
    "lutein_zeaxanthin_ug": (1123,),
}
LIST_MACROS = ("energy_kcal", "protein_g", "fat_g", "carb_g")
MERGE_MACROS = ("protein_g", "carb_g", "fat_g")
EXTRA_NUTRIENTS = ("fiber_g", "sugar_g", "sat_fat_g", "sodium_mg")
MISSING_RANK = 999999

# --- Fixed values: caps and thresholds -------------------------------------
MAX_PAIRS_PER_FOOD = 25
MAX_KEYWORDS = 20
LONGEST_KEYWORD = 40
MAX_GROUP_DESCRIPTIONS = 4
CANON_BATCH_SIZE = 40
MAX_INPUT_FOODS = 6
HIGH_THRESHOLD = 0.80
PREP_DISTANCE = 0.20
PREP_FLOOR_G = 5.0
FLUSH_EVERY = 250
ERROR_TEXT_CHARS = 500
PROMPT_PRICE_PER_M = 0.1288
COMPLETION_PRICE_PER_M = 0.5336
MIN_GRAMS, MAX_GRAMS, DEFAULT_GRAMS = 1.0, 2000.0, 100.0
CONFIDENCE_FLOOR = 0.35
MATCH_THRESHOLD = 0.6
MAX_SHOTS = 8
MAX_ID_CHARS = 40
MAX_EMOJI_BYTES = 8
OUNCE_G = 28.35
RECENT_DAYS, RANKING_DAYS = 14, 90
SEARCH_LIMIT, MATCH_LIMIT, CUSTOM_LIMIT, RECENT_LIMIT = 30, 10, 20, 20
FALLBACK_BELOW = 5
FIRST_HOUR, LAST_HOUR = 5, 23
DAILY_TARGETS = {"energy_kcal": 2850.0, "protein_g": 180.0, "carb_g": 320.0, "fat_g": 75.0}
PORTION_FRACTIONS = (0.08, 0.15, 0.25, 0.4, 0.55, 0.75)
INDEX_WEIGHTS = {"name": 10.0, "prep": 2.0, "aka": 3.0, "members": 1.0}
BM25_K1, BM25_B, BM25_IDF_FLOOR = 1.2, 0.75, 1e-6
RANK_WEIGHTS = {
    "commonness": 1.0, "commonness_default": 0.4, "cooked": 0.3, "recency": 1.5,
    "recency_cap": 3, "exact": 0.6, "penalty": 0.3,
}
#: What an item's rank can be multiplied by at least and at most, its commonness lying between 0 and 1.
LEAST_FACTOR = 1 - RANK_WEIGHTS["penalty"]
GREATEST_FACTOR = 1 + sum(RANK_WEIGHTS[k] for k in ("commonness", "cooked", "recency", "exact"))
PENALTY_TERMS = ("restaurant", "school lunch", "baby food")

# --- Fixed values: patterns --------------------------------------------------
FAT_LEVEL_PATTERN = r"\d+(\.\d+)?\s*%\s*(lean|fat|milkfat)?"
LEADING_ONE_PATTERN = r"^1\s+"

# --- Fixed values: vocabularies --------------------------------------------
FOOD_KINDS = ("ingredient", "dish")
PREP_TYPES = (
    "raw", "cooked", "roasted", "baked", "boiled", "fried", "grilled",
    "steamed", "braised", "broiled", "dried", "canned", "frozen", "smoked",
    "toasted", "poached", "scrambled", "stewed", "microwaved", "sauteed",
    "blanched", "pickled", "cured", "brewed", "drained",
)
COOKED_METHODS = (
    "roasted", "baked", "boiled", "fried", "grilled", "steamed", "braised",
    "broiled", "poached", "scrambled", "stewed", "microwaved", "sauteed",
    "blanched", "toasted",
)
NAME_PREP_WORDS = PREP_TYPES + ("fresh", "heated", "unheated", "prepared", "cooking")
RAW_WORDS = ("raw", "unprepared", "uncooked")
KEY_STOPWORDS = ("the", "a", "an", "and", "or", "of", "in")
SYNONYM_TYPES = ("Common Name", "Additional Description")
PRESERVE_TOKENS = (
    "raw", "cooked", "roasted", "baked", "boiled", "fried", "grilled",
    "steamed", "braised", "dried", "canned", "frozen", "smoked", "drained",
    "with", "without", "salt", "salted", "unsalted", "lean", "fat",
    "milkfat", "skin", "boneless", "skinless",
)
MEAT_DAIRY_KEYWORDS = (
    "beef", "pork", "poultry", "chicken", "turkey", "lamb", "veal", "game",
    "sausage", "luncheon", "cured meat", "cold cuts", "ground meat",
    "dairy", "milk", "cheese", "yogurt", "cream", "egg",
)

# --- Fixed values: abbreviation rules (name, pattern, replacement, any case) --
ABBREVIATION_RULES = (
    ("w/o", r"(?<![\w/])w/o(?![\w/])", "without", True),
    ("w/", r"(?<![\w/])w/(?!o\b)", "with ", True),
    ("NFS", r"\bNFS\b", "not further specified", False),
    ("NS", r"\bNS\b", "not specified", False),
    ("prep", r"\bprep\b\.?", "prepared", True),
    ("reg", r"\breg\b\.?", "regular", True),
    ("incl", r"\bincl\b\.?", "including", True),
    ("approx", r"\bapprox\b\.?", "approximately", True),
)

# --- Fixed values: brand words and shouted words that are not brands --------
BRAND_TOKENS = (
    "mcdonald", "burger king", "wendy's", "kfc", "kentucky fried",
    "taco bell", "pizza hut", "domino's", "subway", "popeyes",
    "chick-fil-a", "arby's", "dairy queen", "little caesars",
    "papa john's", "denny's", "applebee's", "cracker barrel",
    "olive garden", "t.g.i. friday", "on the border", "carrabba",
    "digiorno", "white castle", "sonic",
    "kraft", "kellogg", "general mills", "quaker", "nabisco", "hershey",
    "nestle", "oscar mayer", "hormel", "jimmy dean", "louis rich",
    "healthy choice", "lean cuisine", "stouffer", "campbell", "progresso",
    "swanson", "ocean spray", "welch", "del monte", "green giant",
    "birds eye", "ore-ida", "heinz", "hellmann", "best foods", "skippy",
    "smucker", "mission foods", "tyson", "perdue", "butterball",
    "van camp", "george weston", "continental mills", "martha white",
    "pillsbury", "betty crocker", "duncan hines", "hungry jack",
    "m&m", "snickers", "twix", "reese", "kit kat", "butterfinger",
    "milky way", "3 musketeers", "starburst", "skittles", "tootsie",
    "mars snackfood", "wm. wrigley", "york peppermint",
    "cheerios", "froot loops", "special k", "rice krispies",
    "frosted flakes", "lucky charms", "cap'n crunch", "chex", "wheaties",
    "grape-nuts", "cream of wheat", "malt-o-meal", "post ",
)
ALLCAPS_WHITELIST = (
    "NFS", "NS", "RTE", "USDA", "USA", "BBQ", "IQF", "UHT", "HVP", "RTD",
    "DHA", "EPA", "ALA", "III", "CO2", "LT", "GT",
)

# --- Own values: plural forms the suffix rules cannot reach ------------------
IRREGULAR_PLURALS = {
    "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse",
    "men": "man", "women": "woman", "children": "child", "oxen": "ox",
    "leaves": "leaf", "loaves": "loaf", "halves": "half", "knives": "knife",
    "calves": "calf", "wolves": "wolf", "shelves": "shelf", "lives": "life",
    "cookies": "cookie", "brownies": "brownie", "pies": "pie", "smoothies": "smoothie",
    "veggies": "veggie", "prairies": "prairie", "calories": "calorie",
}
