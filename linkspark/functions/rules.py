"""Fixed values (word lists, tables and patterns the results depend on)."""

# Trailing legal form -> canonical name; other self-named forms stand for themselves.
LEGAL_SUFFIXES = {
    "co": "company", "company": "company", "corp": "corporation", "corporation": "corporation", "inc": "incorporated",
    "inc.": "incorporated", "incorporated": "incorporated", "ltd": "limited", "ltd.": "limited", "limited": "limited",
    "llc": "llc", "l.l.c": "llc", "llp": "llp", "llp.": "llp", "plc": "plc", "pllc": "pllc", "pc": "pc", "o.d.": "o.d.",
    "dds": "dds", "md": "md", "phd": "phd", "esq": "esq",
}
# State keys in the order in which the first one present wins.
STATES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa "
    "ri sc sd tn tx ut vt va wa wv wi wy dc ka karnataka"
).split()
UNIT_LABELS = ("unit", "apt", "apartment", "flat", "fl", "suite", "ste", "#", r"h\.?no\.?", r"s\.?no\.?")
COUNTRIES = {"0": "0", "1": "1", "2": "2", "india": "0", "us": "1", "usa": "1", "united states": "1", "france": "2"}
# Spellings that tabular readers take for a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Patterns for the JVM. A word character is a letter, a number or _, not a combining mark.
C = r"\p{L}\p{N}_"
S = r"[\s\p{Z}\x1c-\x1f\x85]"
B = rf"(?:(?<=[{C}])(?![{C}])|(?<![{C}])(?=[{C}]))"
WORD = rf"[{C}]+"
NUMBER = rf"(?<![{C}])\p{{Nd}}+(?:[-/]\p{{Nd}}+)*(?![{C}])"
POSTAL = rf"(?iu){B}\p{{Nd}}{{5}}(?:(?:-|{S})\p{{Nd}}{{4}})?{B}|{B}[A-Z]\p{{Nd}}[A-Z]{S}?\p{{Nd}}[A-Z]\p{{Nd}}{B}"
LABEL = "(?:" + "|".join(UNIT_LABELS) + ")"
UNIT = rf"(?iu){B}{LABEL}{S}*[{C}-]+{B}"
UNIT_LABEL = rf"(?iu)^{LABEL}{S}*"
STATE = rf"(?iu){B}(?:{'|'.join(STATES)}){B}"
DOMAIN = rf"(?iu){B}[{C}-]+\.[a-z]{{2,}}(?:\.[a-z]{{2,}})?{B}"
SUFFIX = rf"(?iu){B}({'|'.join(k.replace('.', '[.]') for k in LEGAL_SUFFIXES)}){S}*$"
DBA = rf"(?iu){B}(?:d/b/a|doing business as){B}"
FKA = rf"(?iu){B}f/k/a{B}|formerly known as"
AKA = rf"(?iu){B}a/k/a{B}|also known as"
INDIC = r"[\x{0900}-\x{0D7F}]"
EDGES = rf"^[^{C}]+|[^{C}]+$"
