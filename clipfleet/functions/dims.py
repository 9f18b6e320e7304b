"""Fixed dimensions: lexicons, aspects, resolutions, framing intents and insets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: fillers, stop words and words that begin a phrase
FILLERS = ("um", "umm", "uh", "uhh", "uhm", "er", "err", "erm", "ah", "ahh", "eh", "hmm", "mm", "mmm", "mhm")
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "is", "are", "was", "were", "this", "that", "it", "with", "at", "as", "by", "be")
BREAK_WORDS = (
    "a", "an", "the",
    "and", "but", "or", "nor", "so", "yet",
    "because", "although", "though", "while", "whereas", "if", "unless",
    "that", "which", "who", "whom", "whose", "when", "where", "as",
    "of", "to", "in", "on", "at", "for", "with", "from", "by", "about",
    "into", "onto", "over", "under", "after", "before", "between", "through",
    "during", "without", "within", "against", "toward", "towards", "up", "out",
    "i", "you", "he", "she", "we", "they", "it",
)
# fixed values: width and height of each aspect
ASPECTS = (("cinematic", 7, 3), ("widescreen", 16, 9), ("full-portrait", 9, 16), ("portrait", 2, 3), ("wide-portrait", 4, 5), ("square", 1, 1), ("classic-tv", 4, 3))
# fixed values: output size by aspect and tier, from high to low
TIERS = ("4k", "1440p", "1080p", "720p")
RESOLUTIONS = {
    "cinematic": ((5040, 2160), (3360, 1440), (2520, 1080), (1680, 720)),
    "widescreen": ((3840, 2160), (2560, 1440), (1920, 1080), (1280, 720)),
    "full-portrait": ((2160, 3840), (1440, 2560), (1080, 1920), (720, 1280)),
    "portrait": ((1440, 2160), (1200, 1800), (1000, 1500), (720, 1080)),
    "wide-portrait": ((1728, 2160), (1152, 1440), (1080, 1350), (576, 720)),
    "square": ((2160, 2160), (1440, 1440), (1080, 1080), (720, 720)),
    "classic-tv": ((2880, 2160), (1920, 1440), (1440, 1080), (960, 720)),
}
# fixed values: scale, height of the subject's centre and caption anchor of each intent
INTENTS = (("talking-head", 1.30, 0.33, "lower-third"), ("performer", 1.00, 0.35, "lower-third"), ("wide-context", 1.00, 0.50, "lower-third"))
# fixed values: (top, right, bottom, left) insets in percent
SUBJECT_INSETS = {"full-portrait": (14, 14, 22, 8), "portrait": (10, 7, 14, 7), "wide-portrait": (10, 7, 14, 7), "square": (8, 8, 12, 8), "widescreen": (6, 6, 10, 6), "cinematic": (6, 6, 10, 6), "classic-tv": (8, 8, 8, 8)}
TEXT_INSETS = {"full-portrait": (18, 16, 28, 10), "portrait": (13, 9, 18, 9), "wide-portrait": (13, 9, 18, 9), "square": (10, 10, 16, 10), "widescreen": (8, 8, 14, 8), "cinematic": (8, 8, 14, 8), "classic-tv": (10, 10, 10, 10)}
# fixed values: caption anchors as percent of the zone's height, and where to look next when one is blocked
ANCHORS = (("upper-third", 6, 34), ("center", 36, 64), ("lower-third", 66, 94))
DODGE = {"lower-third": ("lower-third", "upper-third", "center"), "upper-third": ("upper-third", "lower-third", "center"), "center": ("center", "upper-third", "lower-third")}
# fixed values: places of a caption in its width, fonts, and kinds of elements that must stay in the safe zone
H_OFFSETS = ("clear-notch", "center")
FONTS = (
    "Archivo", "Inter", "IBM Plex Mono",
    "Helvetica", "Helvetica Neue", "Arial", "Arial Black", "Avenir Next", "Futura", "Gill Sans",
    "Impact", "Verdana", "Georgia", "Times New Roman", "Courier New", "Menlo", "Trebuchet MS",
)
PROTECTED_KINDS = ("caption", "logo", "cta", "text", "graphic")
# fixed values: keys of a caption style with type
STYLE_KEYS = (("font_family", "string"), ("font_size", "long"), ("font_weight", "long"), ("fill_color", "string"), ("stroke_color", "string"), ("stroke_width", "long"), ("emphasis_color", "string"), ("uppercase", "boolean"), ("position", "string"), ("h_offset", "string"), ("bg_enabled", "boolean"), ("bg_color", "string"), ("bg_radius", "long"), ("max_words", "long"), ("min_words", "long"), ("max_chars", "long"), ("max_gap_s", "double"), ("emphasize_glossary_terms", "boolean"), ("target_words", "long"), ("break_words", "string"), ("karaoke", "boolean"))


def aspect_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASPECTS, "aspect string, aw long, ah long")


def resolution_matrix(spark: SparkSession) -> DataFrame:
    rows = [(a, t, k, *RESOLUTIONS[a][k]) for a in RESOLUTIONS for k, t in enumerate(TIERS)]
    return spark.createDataFrame(rows, "aspect string, tier string, tier_rank long, tw long, th long")


def framing_intents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTENTS, "intent string, subject_scale double, y_frac double, caption_position string")


def generic_insets(spark: SparkSession) -> DataFrame:
    rows = [(a, p, *t[a]) for p, t in (("subject", SUBJECT_INSETS), ("text", TEXT_INSETS)) for a in t]
    return spark.createDataFrame(rows, "aspect string, purpose string, it long, ir long, ib long, il long")


def values_sql(rows, names: str) -> str:
    """The rows as a SQL VALUES list, for the DuckDB side."""
    one = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"
