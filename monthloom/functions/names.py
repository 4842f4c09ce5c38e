"""Normalised names, keys and keyword classes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# All lists and labels below, down to SALT_TAILS.

#: Words without weight in a company's name.
COMPANY_WORDS = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "llc", "pllc", "pc", "lp", "llp", "ltd", "limited",
    "pharmaceutical", "pharmaceuticals", "pharma", "pharm", "labs", "laboratories", "laboratory",
)
#: Phrases between a company's name and another of its names.
OTHER_NAMES = ("d/b/a", "dba", "aka", "f/k/a", "formerly known as")
#: Salt names and their short forms.
SALTS = (
    ("HYDROCHLORIDE", "HCL"), ("HYDROBROMIDE", "HBR"), ("SODIUM", "SOD"), ("POTASSIUM", "POT"), ("SUCCINATE", "SUCC"),
)
#: Reason texts that say nothing.
UNKNOWN_REASONS = ("", "nan", "unknown", "unknown reason", "not known", "not available")
#: Parts of a reason text and its class, the first that matches counting.
REASONS = (
    (("discontinu", "withdrawn"), "Discontinuation"),
    (("demand",), "Demand increase"),
    (("manufactur",), "Manufacturing"),
    (("raw material", "active ingredient", "api", "active pharmaceutical"), "Raw material/API"),
    (("regulatory", "gmp", "compliance", "fda"), "Regulatory/GMP"),
    (("shipping", "distribution", "logistic"), "Shipping/Distribution"),
    (("hurricane", "disaster", "natural", "earthquake", "storm"), "Natural disaster"),
    (("recall", "quality", "contamina", "sterility", "particulate"), "Quality/Recall"),
    (("business",), "Business decision"),
    (("capacity",), "Capacity"),
)
#: Words of dosage forms and containers that are no part of a name.
FORM_WORDS = (
    "injection", "injectable", "inj", "tablet", "tablets", "tabs", "capsule", "capsules", "oral", "topical", "cream",
    "ointment", "solution", "suspension", "syrup", "patch", "patches", "suppository", "suppositories", "inhalation",
    "inhaler", "inhalers", "nasal", "ophthalmic", "otic", "rectal", "vaginal", "transdermal", "sublingual", "powder",
    "drops", "gel", "lotion", "spray", "enema", "implant", "insert", "ring", "film", "liquid", "concentrate", "elixir",
    "iv", "im", "sq", "vials", "vial", "syringe", "syringes", "bags", "bag", "infusion", "prefilled", "pen", "pens", "kit",
    "kits", "ampul", "ampule", "large", "volume", "small", "flush", "chewable", "extended-release", "extended", "release",
    "delayed-release", "delayed", "immediate-release", "immediate", "sustained-release", "sustained", "odt", "er", "sr",
    "cr", "xl", "xr", "la", "dr", "lozenge", "lozenges", "pastilles", "jelly", "paste", "premixed", "premixes", "frozen",
    "soln", "carpujects", "spansules", "metered", "dose", "metered-dose", "intravenous", "intramuscular", "subcutaneous",
    "pediatric", "adult", "unit", "preservative", "free", "presentations", "formulations", "products", "generic",
)
#: Words of a name and the dosage forms they hint at; those of the first list go before those of the second.
FORM_HINTS = {
    "injection": ("INJECTION",), "injectable": ("INJECTION",), "inj": ("INJECTION",), " iv": ("INJECTION",),
    "intravenous": ("INJECTION",), "infusion": ("INJECTION",), "tablet": ("TABLET",), "tabs": ("TABLET",),
    "capsule": ("CAPSULE",), "cream": ("CREAM",), "ointment": ("OINTMENT",), "gel": ("GEL",), "lotion": ("LOTION",),
    "solution": ("SOLUTION",), "suspension": ("SUSPENSION",), "syrup": ("SYRUP",), "elixir": ("ELIXIR",),
    "suppository": ("SUPPOSITORY",), "suppositories": ("SUPPOSITORY",), "patch": ("PATCH",),
    "inhalation": ("INHALANT", "AEROSOL", "POWDER"), "inhaler": ("INHALANT", "AEROSOL"), "spray": ("SPRAY",),
    "enema": ("ENEMA",), "implant": ("IMPLANT",), "powder": ("POWDER",), "drops": ("SOLUTION",), "syringe": ("INJECTION",),
    "syringes": ("INJECTION",), "vial": ("INJECTION",), "vials": ("INJECTION",), "bag": ("INJECTION",),
    "bags": ("INJECTION",), "ampule": ("INJECTION",), "pen": ("INJECTION",), "prefilled": ("INJECTION",),
    "lozenge": ("LOZENGE",), "pastille": ("LOZENGE",), "film": ("FILM",), "jelly": ("GEL",), "paste": ("PASTE",),
    "concentrate": ("SOLUTION",), "liquid": ("SOLUTION", "SUSPENSION", "SYRUP", "ELIXIR"), "kit": ("KIT",),
    "aerosol": ("AEROSOL",), "foam": ("AEROSOL",), "tincture": ("TINCTURE", "SOLUTION"),
    "emulsion": ("EMULSION", "INJECTION"), "pellet": ("PELLET",), "granule": ("GRANULE",),
}
BROAD_HINTS = {
    "oral": ("TABLET", "CAPSULE", "SOLUTION", "SUSPENSION", "SYRUP"), "transdermal": ("PATCH",), "nasal": ("SPRAY", "SOLUTION"),
    "ophthalmic": ("SOLUTION", "SUSPENSION"), "otic": ("SOLUTION", "SUSPENSION"),
    "topical": ("CREAM", "OINTMENT", "GEL", "LOTION", "SOLUTION"), "irrigation": ("IRRIGANT", "SOLUTION", "INJECTION"),
    "metered dose": ("AEROSOL",), "metered-dose": ("AEROSOL",), "chewable": ("TABLET",), "odt": ("TABLET",),
    "sublingual": ("TABLET",), "vaginal": ("INSERT", "CREAM", "TABLET", "SUPPOSITORY"), "rectal": ("SUPPOSITORY", "ENEMA"),
    "capsule, extended": ("CAPSULE, EXTENDED RELEASE",), "extended-release capsule": ("CAPSULE, EXTENDED RELEASE",),
    "extended release capsule": ("CAPSULE, EXTENDED RELEASE",), "extended-release tablet": ("TABLET, EXTENDED RELEASE",),
    "extended release tablet": ("TABLET, EXTENDED RELEASE",),
    "delayed release": ("CAPSULE, DELAYED RELEASE", "TABLET, DELAYED RELEASE"),
}
#: Qualifiers of a substance after its name.
GRADES = ("USP", "NF", "BP", "EP", "JP", "DRUG SUBSTANCE", "MICRONIZED", "NON-STERILE", "STERILE", "BULK DRUG", "ANHYDROUS")
#: Patterns in a holder's name in upper case and the country they tell, in this order.
HOLDERS = (
    ("INDIA", (
        "ALKEM", "CIPLA", "DR REDDY", "SUN PHARMA", "LUPIN", "WOCKHARDT", "AUROBINDO", "HETERO", "LAURUS", "BIOCON", "NEULAND",
        "IPCA", "MANKIND", "ZYDUS", "UNICHEM", "ORCHID", "SHILPA", "HARMAN FINO", "NECTAR LIFE", "ALEMBIC", "HONOUR LAB",
        "ALIVUS", "COHANCE", "DIVIS LAB", "GLENMARK", "JUBILANT", "NATCO", "STRIDES", "TORRENT", "CADILA", "MSN LAB",
        "LAXMI ORGANIC", "SUVEN", "SOLARA", "GRANULES", "AARTI", "HIKAL", "DIVI", "MYLAN LAB", "PIRAMAL", "OPTIMUS", "VASUDHA",
        "SYNGENE", "MEGAFINE", "VIVIMED", "SEQUENT", "SRI KRISHNA", "WAVELENGTH", "PERRIGO API", "CELLUPRO", "CENTAUR PHARMA",
        "CHEM TECH", "SUPRIYA LIFE", "CTX LIFE", "SIGACHI", "CHIRAL BIOSCIENCES", "PRIVATE LTD", "PVT LTD", "INDIA", "HYDERABAD",
        "MUMBAI", "CHENNAI", "BANGALORE", "GUJARAT", "AURANGABAD", "VIZAG", "VISAKHAPATNAM", "AHMEDABAD", "PUNE", "NAGPUR",
        "KOLKATA", "THANE", "VADODARA", "GOA", "SIKKIM", "BADDI",
    )),
    ("CHINA", (
        "WUHAN", "YANGZHOU", "WUXI", "ALLSINO", "CHENGDA", "HISOUND", "YABAO", "REGEN-AGEEK", "SUZHOU NANOMICRO", "WISDOM PHARMA",
        "ZHUHAI", "NOVOPROTEIN", "EL-PEPTIDO", "EI-PEPTIDO", "CHANGZHOU", "NANJING", "GUANGZHOU", "XINHUA", "LUYE", "APELOA",
        "PORTON", "ASYMCHEM", "SHANGHAI", "BEIJING", "ZHEJIANG", "SHANDONG", "JIANGSU", "HEBEI", "HUBEI", "SICHUAN", "GUANGDONG",
        "ANHUI", "CHONGQING", "HANGZHOU", "SHENZHEN", "TIANJIN", "CHINA", "HEILONGJIANG", "HENAN", "HUNAN", "FUJIAN", "LIAONING",
        "SUZHOU", "DALIAN", "KUNMING", "HAINAN", "INNER MONGOL", "JIANGXI", "QINGDAO", "YANTAI", "TAIZHOU", "NINGBO", "XIAMEN",
        "CHENGDU", "LANZHOU", "GANSU", "GUIZHOU", "YUNNAN", "SHAANXI", "SHANXI",
    )),
    ("ITALY", ("ITALY", "ITALIA", "S.P.A", "S.R.L", "MILANO")),
)
LATER_HOLDERS = (
    ("GERMANY", ("GERMANY", "GMBH", "DEUTSCHLAND")),
    ("SWITZERLAND", ("SWITZERLAND", "SIEGFRIED", "CERBIOS")),
    ("USA", (" INC", " LLC", " CORP", "USA", "U.S.", "AMERICA")),
    ("ISRAEL", ("ISRAEL", "TEVA ")),
    ("JAPAN", ("JAPAN", "TOKYO", "OSAKA")),
    ("SOUTH KOREA", ("KOREA", "SEOUL")),
    ("NETHERLANDS", (" BV", "NETHERLANDS")),
    ("FRANCE", ("FRANCE", "PARIS", " SAS")),
    ("SPAIN", ("SPAIN", "ESPANA")),
    ("UK", ("UNITED KINGDOM", " PLC")),
)
COUNTRY_CODES = {
    "INDIA": "IND", "CHINA": "CHN", "USA": "USA", "ITALY": "ITA", "GERMANY": "DEU", "SWITZERLAND": "CHE", "ISRAEL": "ISR",
    "JAPAN": "JPN", "SOUTH KOREA": "KOR", "NETHERLANDS": "NLD", "FRANCE": "FRA", "SPAIN": "ESP", "UK": "GBR",
}
#: Salts that may end a name, and those that are tried behind one, in this order.
SALT_TAILS = (
    "hydrochloride", "hcl", "hci", "sodium", "sulfate", "potassium", "acetate", "phosphate", "mesylate", "maleate", "tartrate",
    "fumarate", "besylate", "succinate", "citrate", "bromide", "chloride", "lactate", "calcium", "dihydrate", "monohydrate",
)
ADDED_SALTS = ("hydrochloride", "sodium", "sulfate", "hcl", "calcium", "potassium")


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def any_of(words) -> str:
    """A pattern of the words as they stand."""
    return "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-").replace("/", "/") for w in words)


def company(s: Column) -> Column:
    """Lower case, & as and, no d/b/a phrases, punctuation or COMPANY_WORDS; null gives an empty string."""
    x = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "&", " and ")
    x = F.regexp_replace(F.regexp_replace(x, any_of(OTHER_NAMES), " "), r"[^a-z0-9\s]", " ")
    return squeeze(F.regexp_replace(x, r"\b(" + "|".join(COMPANY_WORDS) + r")\b", " "))


def drug(s: Column) -> Column:
    """Upper case, short salt names, AND between ingredients as /; null gives an empty string."""
    x = F.trim(F.upper(F.coalesce(s, F.lit(""))))
    x = reduce(lambda c, r: F.regexp_replace(c, rf"\b{r[0]}\b", r[1]), SALTS, x)
    return squeeze(F.regexp_replace(x, r"\b AND \b", "/"))


def base_name(s: Column) -> Column:
    """A name without brackets, strengths, sizes, schedules, form words and what then dangles.

    A leading percentage stays. Where nothing is left, the lower-case name itself; null gives an empty string.
    """
    low = F.trim(F.lower(s))
    x = F.trim(F.regexp_replace(low, r"\([^)]*\)", ""))
    lead = F.regexp_extract(x, r"^(\d+\.?\d*%)\s+", 1)
    x = F.when(lead != "", F.regexp_replace(x, r"^\d+\.?\d*%\s+", "")).otherwise(x)
    for gone in (
        r"\d+\.?\d*\s*(?:mg|mcg|g|ml|meq|units?|iu|gram|grams|mcg/ml|mg/ml|mg/g|mcg/hr|mg/hr)\b",
        r"\d+\.?\d*\s*%",
        r"\d+\.?\d*\s*(?:oz|ml|cc|l|gram|grams|tube|bottles?|ampules?|pk)\b",
        r"\bc-(?:ii|iii|iv|v)\b",
        r"\b\d+\.?\d*\b",
    ):
        x = F.regexp_replace(x, gone, "")
    bare = lambda t: F.regexp_replace(t, "^[,/;-]+|[,/;-]+$", "")
    words = F.filter(F.split(F.trim(x), r"\s+"), lambda t: (bare(t) != "") & ~bare(t).isin(*FORM_WORDS))
    x = F.regexp_replace(F.array_join(words, " "), r"(^|\s+)([,-]*(and|or|with|for|in)[,-]*(\s+|$))+$", "")
    x = F.regexp_replace(x, "^[ ,;/-]+|[ ,;/-]+$", "")
    x = squeeze(F.concat(F.when(lead != "", F.concat(lead, F.lit(" "))).otherwise(F.lit("")), x))
    return F.coalesce(F.when(x != "", x).otherwise(low), F.lit(""))


def form_hints(low: Column) -> Column:
    """Dosage forms that a lower-case name hints at, sorted: by specific words, else by broad ones."""

    def hints(table: dict[str, tuple[str, ...]]) -> Column:
        def held(word: str) -> Column:
            return low.rlike(rf"\b{word}\b") if len(word) <= 3 else low.contains(word)

        none = F.array().cast("array<string>")
        return F.flatten(F.array(*[F.when(held(w), F.array(*map(F.lit, forms))).otherwise(none) for w, forms in table.items()]))

    narrow = hints(FORM_HINTS)
    return F.array_sort(F.array_distinct(F.when(F.size(narrow) > 0, narrow).otherwise(hints(BROAD_HINTS))))


def ingredient(s: Column) -> Column:
    """Upper case without GRADES; null gives an empty string."""
    x = F.trim(F.upper(F.coalesce(s, F.lit(""))))
    return squeeze(F.regexp_replace(x, r"\s+(" + any_of(GRADES) + r")\b", ""))


def plain_ingredient(s: Column) -> Column:
    """Lower-case letters without brackets and optical prefixes (d-, l-, dl-, d,l-)."""
    x = F.regexp_replace(F.lower(s), r"\(.*?\)", "")
    return squeeze(F.regexp_replace(F.regexp_replace(x, r"\b[dl],?[dl]?-", ""), "[^a-z ]", " "))


def holder_country(s: Column) -> Column:
    """The country that a holder's name tells; UNKNOWN without a name, OTHER where nothing tells it."""
    h = F.trim(F.upper(s))
    out = F.when(s.isNull(), "UNKNOWN")
    for country, words in HOLDERS:
        out = out.when(h.rlike(any_of(words)), country)
    out = out.when(h.rlike(r"\bS\.?P\.?A\.?\s*$") & ~h.contains("USA"), "ITALY")
    for country, words in LATER_HOLDERS:
        out = out.when(h.rlike(any_of(words)), country)
    return out.when(h.endswith(" LTD") & ~h.rlike("CO LTD|BV|SA|AG"), "INDIA").otherwise("OTHER")


def country_code(country: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in COUNTRY_CODES.items() for x in kv]), country)


def group_key(*parts: Column) -> Column:
    """Parts in lower case without brackets, joined by a spaced bar."""
    clean = [squeeze(F.regexp_replace(F.lower(F.coalesce(p, F.lit("unknown"))), r"[()]", " ")) for p in parts]
    return F.concat_ws(" | ", *[F.trim(F.regexp_replace(c, r"^[ .,\-]+|[ .,\-]+$", "")) for c in clean])


def first_class(s: Column, *marks: str) -> Column:
    """First item of a comma list with the first mark that any item has; else the first item."""
    items = F.transform(F.split(s, ","), lambda x: F.trim(x))

    def marked(mark: str) -> Column:
        return F.try_element_at(F.filter(items, lambda x: x.contains(mark)), F.lit(1))

    first = F.try_element_at(items, F.lit(1))
    return F.coalesce(*map(marked, marks), F.when(first != "", first))


def reason(s: Column) -> Column:
    """Class of a reason text by REASONS."""
    low = F.lower(F.trim(s))
    out = F.when(s.isNull() | low.isin(*UNKNOWN_REASONS), "Unknown")
    for words, name in REASONS:
        out = out.when(low.rlike(any_of(words)), name)
    return out.otherwise("Other")


def item_count(s: Column, sep: str = ";") -> Column:
    return F.when(s.isNull() | (F.trim(s) == ""), 0).otherwise(F.size(F.split(s, sep)))


def snake(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower().replace("/", " per ")).strip("_")


def names_digest(names: Column) -> Column:
    return F.md5(F.array_join(F.array_sort(names), "\n"))
