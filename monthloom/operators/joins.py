"""Joins without look-ahead, with fallbacks, and by similar names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..functions.fuzzy import indel_ratio, pairs_of_letters, sorted_tokens, token_set_ratio, tokens
from ..scratch import cut
from .spine import expand_interval
from .windows import first_by


def star_left(spine: DataFrame, *tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """Left joins of tables, unique on their keys, onto the spine; those on equal keys share one exchange."""
    for table, keys in tables:
        spine = spine.join(table, keys, "left")
    return spine


def event_windows(spine: DataFrame, events: DataFrame, by: list[str], spans: dict[str, int], month: str = "ym") -> DataFrame:
    """Events of the n months before each spine row, for each name and n of spans.

    Monthly counts meet the spine once and are summed over ranges of months on one sort. Months with events
    that the spine lacks take part in the sums and are then dropped.
    """
    counts = events.groupBy(*by, month).agg(F.count("*").alias("__n"))
    both = spine.withColumn("__in", F.lit(True)).join(counts, [*by, month], "full")
    w = Window.partitionBy(*by).orderBy(month)
    sums = {k: F.coalesce(F.sum("__n").over(w.rangeBetween(-n, -1)), F.lit(0)) for k, n in spans.items()}
    return both.withColumns(sums).where("__in").drop("__in", "__n")


def interval_months(spine: DataFrame, intervals: DataFrame, by: list[str], order: list[Column], month: str = "ym") -> DataFrame:
    """Spine months covered by an interval (start, end) of the entity, the first in ``order`` winning."""
    one = first_by(expand_interval(intervals, "start", "end", month), [*by, month], *order)
    return spine.join(one, [*by, month], "inner")


def asof_prior(months: DataFrame, snaps: DataFrame, year: str = "year", snap: str = "snap") -> DataFrame:
    """(year, snap): the latest snapshot strictly before each year, else the earliest; both sides are year lists."""
    pairs = months.select(year).distinct().join(F.broadcast(snaps.select(snap).distinct()), F.lit(True), "left")
    latest = F.max(F.when(F.col(snap) < F.col(year), F.col(snap)))
    return pairs.groupBy(year).agg(F.coalesce(latest, F.min(snap)).alias(snap))


def cascade(keys: DataFrame, snapshots: DataFrame, by: list[str], priority: Column, value: str) -> DataFrame:
    """Value of the first snapshot, by priority, in which a key has one."""
    return keys.join(first_by(snapshots.where(F.col(value).isNotNull()), by, priority), by, "left")


def two_tier(left: DataFrame, right: DataFrame, exact: str, loose: str, value: str) -> DataFrame:
    """Value by exact name, else by normalised name; right is reduced to one row per name on each tier."""
    tier = lambda k, n: right.groupBy(k).agg(F.min(value).alias(n))
    out = left.join(tier(exact, "__a"), exact, "left").join(tier(loose, "__b"), loose, "left")
    tiers = F.when(F.col("__a").isNotNull(), "exact").when(F.col("__b").isNotNull(), "normalised")
    return out.withColumns({value: F.coalesce("__a", "__b"), "tier": tiers}).drop("__a", "__b")


def _rarest(names: DataFrame, counts: DataFrame, key: str, text: str, floor: float) -> DataFrame:
    """(key, gram): of a name's pairs of letters, the rarest ones, so many that a similar name holds one of its own rarest among them."""
    grams = names.select(key, text, F.explode(pairs_of_letters(F.col(text))).alias("gram")).join(counts, "gram")
    few = grams.groupBy(key, text).agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("g"))
    n = F.size("g")
    shared = F.ceil(F.lit(floor) * F.length(text) - 1)  # pairs that a similar name has in common with it, at least
    return few.select(key, F.explode(F.slice("g", F.lit(1), F.greatest(n - F.greatest(shared, F.lit(1)) + 1, F.lit(1)).cast("int"))).alias("g")).select(key, "g.gram")


def _edits(la: Column, lb: Column, cutoff: float) -> Column:
    """Letters to insert or delete, at most, between strings of these lengths whose ratio reaches the cutoff; of their parity."""
    loose, total = 10_000 - round(100 * cutoff), la + lb
    most = F.floor(loose * total / 10_000).cast("int")
    return most - (total - most) % 2


def _lengths(n: Column, cutoff: float) -> Column:
    """Lengths that a string of length n can be similar to."""
    c = round(100 * cutoff)
    return F.sequence(F.ceil(n * c / (20_000 - c)).cast("int"), F.floor(n * (20_000 - c) / c).cast("int"))


def _segments(length: Column, edits: Column) -> Column:
    """(i, start, size) of edits + 1 even parts of a string, from 0; later parts are the longer ones."""
    size, more = F.floor(length / (edits + 1)).cast("int"), length % (edits + 1)
    short = edits + 1 - more
    start = lambda i: i * size + F.greatest(i - short, F.lit(0))
    return F.transform(F.sequence(F.lit(0), edits), lambda i: F.struct(i.alias("i"), start(i).alias("start"), (size + (i >= short).cast("int")).alias("size")))


def similar_pairs(a: DataFrame, b: DataFrame, x: str, y: str, cutoff: float) -> DataFrame:
    """(x, y) of all pairs of strings whose indel ratio may reach the cutoff (50 or more): none that does is missed.

    Two strings with at most e insertions and deletions between them: of e + 1 parts of the one, an edit spoils one at most,
    so one part stands in the other, shifted by no more letters than were inserted or deleted before it, and after it. So
    each y is laid down by its parts for each possible e, and each x looks parts up at these places only.
    """
    if cutoff < 50:
        raise ValueError("a cutoff below 50 would ask for parts of no letters")
    n = F.length
    kept = b.select(y).distinct().where(n(y) > 0)
    kept = kept.select(y, n(y).alias("len"), F.explode(F.array_distinct(F.transform(_lengths(n(y), cutoff), lambda m: _edits(m, n(y), cutoff)))).alias("e"))
    kept = kept.select(y, "len", "e", F.explode(_segments(F.col("len"), F.col("e"))).alias("p"))
    kept = kept.select(y, "len", "e", "p.i", F.col(y).substr(F.col("p.start") + 1, F.col("p.size")).alias("part"))
    tried = a.select(x).distinct().where(n(x) > 0).select(x, F.explode(_lengths(n(x), cutoff)).alias("len"))
    tried = tried.withColumn("e", _edits(n(x), F.col("len"), cutoff)).withColumn("p", F.explode(_segments(F.col("len"), F.col("e"))))
    i, gap, e = F.col("p.i"), n(x) - F.col("len"), F.col("e")
    low, high = F.greatest(-i, gap - (e - i), -F.col("p.start")), F.least(i, gap + (e - i), n(x) - F.col("p.start") - F.col("p.size"))
    tried = tried.withColumns({"low": low, "high": high}).where("low <= high").withColumn("shift", F.explode(F.sequence("low", "high")))
    tried = tried.select(x, "len", "e", "p.i", F.col(x).substr(F.col("p.start") + F.col("shift") + 1, F.col("p.size")).alias("part"))
    return tried.distinct().join(kept, ["len", "e", "i", "part"]).select(x, y).distinct()


def one_letter_apart(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) of all pairs of strings that are equal or differ by one letter that one of them has more."""
    fewer = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.left(c, i - 1), c.substr(i + 1, F.length(c)))))
    one = a.where(F.length(x) > 0).select(x).distinct()
    two = b.where(F.length(y) > 0).select(y).distinct()
    forms = lambda d, c: d.select(c, F.explode(F.concat(F.array(c), fewer(F.col(c)))).alias("form"))
    met = forms(one, x).join(two.withColumn("form", F.col(y)), "form")
    return met.unionByName(one.withColumn("form", F.col(x)).join(two.select(y, F.explode(fewer(F.col(y))).alias("form")), "form")).select(x, y)


def _token_prefixes(names: DataFrame, counts: DataFrame, key: str, share: float) -> DataFrame:
    """(key, token): the rarest tokens, so many that without them less than share of a name's letters is left."""
    t = names.select(key, F.explode(F.array_distinct(tokens(F.col(key)))).alias("token")).join(counts, "token")
    held = t.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("g"), (F.sum(F.length("token")) + F.count("*") - 1).alias("size"))
    # letters and blanks of the tokens from i on
    rest = lambda i: F.aggregate(F.slice("g", i + 1, F.size("g")), F.lit(-1).cast("long"), lambda s, x: s + F.length(x["token"]) + 1)
    need = F.filter(F.sequence(F.lit(0), F.size("g") - 1), lambda i: rest(i) >= share * F.col("size"))
    return held.select(key, F.explode(F.transform(need, lambda i: F.get("g", i)["token"])).alias("token"))


def fuzzy_best(left: DataFrame, right: DataFrame, name: str, choice: str, cutoff: float, scorer: str = "sort") -> DataFrame:
    """Best choice by the ratio of sorted tokens (or of token sets), at least cutoff; ties take the first name.

    No pair that could be the best is missed. Sorted tokens meet where they are one_letter_apart; only names that these pairs
    leave open meet by their parts (similar_pairs). Token sets meet in one of two ways. Either the tokens in common are most letters of one side; then they hold one of the rarest tokens of that
    side, without which too few letters are left. Or both wholes are similar, whatever the order of their tokens: of
    strings whose lengths sum to s, those with ratio c have c * s / 2 letters in common order; leaving the others out
    breaks at most 2 pairs of neighbours each in one and inserting them 1, so (3 c / 2 - 1) * s - 1 pairs stay common,
    and s is at least (1 + c / (2 - c)) times the length of either; so the rarest pairs of letters of both share one.
    """
    c = cutoff / 100
    a = cut(left.select(name).distinct().withColumn("__a", sorted_tokens(F.col(name))))
    b = cut(right.select(choice).distinct().withColumn("__b", sorted_tokens(F.col(choice))))
    la, lb = F.length("__a"), F.length("__b")
    near, open_ = None, a
    if scorer == "sort":
        near = cut(one_letter_apart(a, b, "__a", "__b")).withColumn("score", 200.0 * F.least(la, lb) / (la + lb))
        # of strings two letters or more apart, no ratio is over la / (la + 1): a better one leaves nothing to find
        open_ = a.join(near.where(F.abs(la - lb) * (la + 1) < la + lb).select("__a").distinct(), "__a", "left_anti")
    met = similar_pairs(open_, b, "__a", "__b", cutoff)
    if scorer == "set":
        floor = (1.5 * c - 1) * (1 + c / (2 - c))
        texts = a.select(F.col("__a").alias("x")).unionByName(b.select(F.col("__b").alias("x")))
        counts = texts.select(F.explode(pairs_of_letters(F.col("x"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        grams = lambda d, k: _rarest(d.select(k).distinct(), counts, k, k, floor)
        met = met.unionByName(grams(a.withColumnRenamed("__a", "__x").select("__x"), "__x").withColumnRenamed("__x", "__a").join(grams(b, "__b"), "gram").select("__a", "__b"))
        words = cut(texts.select(F.explode(F.array_distinct(tokens(F.col("x")))).alias("token")).groupBy("token").agg(F.count("*").alias("n")))
        every = lambda d, k: d.select(k, F.explode(F.array_distinct(tokens(F.col(k)))).alias("token"))
        for one, two in ((("__a", a), ("__b", b)), (("__b", b), ("__a", a))):
            few = _token_prefixes(one[1].select(one[0]).distinct(), words, one[0], c / (2 - c))
            met = met.unionByName(few.join(every(two[1].select(two[0]).distinct(), two[0]), "token").select("__a", "__b"))
    score = token_set_ratio(F.col("__a"), F.col("__b")) if scorer == "set" else indel_ratio(F.col("__a"), F.col("__b"), cutoff)
    scored = met.distinct().withColumn("score", score)
    scored = scored.unionByName(near) if near is not None else scored
    firsts = b.groupBy("__b").agg(F.min(choice).alias(choice))
    best = first_by(scored.where(F.col("score") >= cutoff).join(firsts, "__b").drop("__b"), ["__a"], F.col("score").desc(), F.col(choice))
    return left.join(a.join(best, "__a").drop("__a"), name, "left")


def match_firms(firms: DataFrame, labels: DataFrame, firm: str, labeler: str, code: str, order: Column, cutoff: float = 85.0) -> DataFrame:
    """firms with the code of the labeler whose normalised name is nearest; a code is represented by its first labeler.

    Empty names match nothing. Of codes with one name the least is taken, of equally near names the first.
    """
    first = first_by(labels, [code], order).where(F.col(labeler) != "").groupBy(labeler).agg(F.min(code).alias(code))
    best = fuzzy_best(firms.where(F.col(firm) != "").select(firm).distinct(), first, firm, labeler, cutoff).where(F.col(labeler).isNotNull())
    return firms.join(best, firm).join(first, labeler)


def resolve(names: DataFrame, passes: list[DataFrame], key: str, target: str) -> DataFrame:
    """Targets of the first pass that finds any; passes hold (key, target). Ties within a pass are all kept."""
    found = None
    for i, p in enumerate(passes):
        q = p.select(key, target, F.lit(i + 1).alias("pass_no")).distinct()
        found = q if found is None else found.unionByName(q)
    first = F.min("pass_no").over(Window.partitionBy(key))
    hits = found.withColumn("__f", first).where("pass_no = __f").drop("__f")
    return names.join(hits, key, "left")


def held_by_parts(listed: DataFrame, holders: DataFrame, by: str, names: str, api: str, holder: str, sep: str = ";") -> DataFrame:
    """(by, holder): holders of a listed name; of a list, those of all its parts, which go before those of the list as a name."""
    clean = lambda c: N.ingredient(c)
    direct = listed.select(by, clean(F.col(names)).alias(api)).join(holders, api).select(by, holder)
    parts = listed.where(F.col(names).contains(sep)).select(by, F.explode(F.split(names, sep)).alias("__p"))
    multi = parts.select(by, clean(F.col("__p")).alias(api)).join(holders, api).select(by, holder)
    return multi.unionByName(direct.join(multi.select(by).distinct(), by, "left_anti"))


def product_keys(items: DataFrame, books: DataFrame, item: str = "item", application: str = "application", fallback: Column | None = None) -> DataFrame:
    """(item, product_key): key of the first book, by its rank (current 0, then the years back), that knows the application.

    items: (item, application, ...), one row per item kept; books: (rank, application, key). Items without one take the
    fallback text (of name, form and route); those whose text is empty, '|;', are dropped.
    """
    known = first_by(books.where(F.col(application).isNotNull()), [application], F.col("rank"), F.col("key")).select(application, "key")
    one = items.dropDuplicates([item]).join(known, application, "left")
    return one.select(item, F.coalesce("key", fallback).alias("product_key")).where(F.trim("product_key") != "|;")


def makers_by_key(keyed: DataFrame, shares: DataFrame, maker: Column) -> DataFrame:
    """(product_key, year, makers, applications): book counts by year; for keys that no book has, distinct makers of items, in all years."""
    others = keyed.join(shares.select("product_key").distinct(), "product_key", "left_anti")
    proxy = others.groupBy("product_key").agg(F.countDistinct(maker).alias("makers"))
    years = shares.select("year").distinct()
    filled = proxy.crossJoin(F.broadcast(years)).select("product_key", "year", "makers", F.col("makers").alias("applications"))  # a few years
    return shares.select("product_key", "year", "makers", "applications").unionByName(filled)


def keep_hits(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    """Rows with a hit, or all rows of a group that has none."""
    any_hit = F.max(hit.cast("int")).over(Window.partitionBy(*by))
    return df.withColumn("__any", any_hit).where((F.col("__any") == 0) | hit).drop("__any")


def without(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def only_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_semi")


#: Words that many substances share; they open no search unless a name has no others.
COMMON_WORDS = (
    "sodium", "chloride", "acid", "hydrochloride", "sulfate", "potassium", "calcium", "phosphate", "acetate", "citrate", "oxide",
    "carbonate", "hydroxide", "bromide", "nitrate", "and", "for", "with", "the", "monohydrate", "dihydrate",
)


def _words(s: Column, edge: str) -> Column:
    """Distinct words of over two characters, without the edge's characters around them."""
    bare = F.transform(F.split(s, r"\s+"), lambda w: F.regexp_replace(w, f"^[{edge}]+|[{edge}]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: F.length(w) > 2))


def match_names(names: DataFrame, panel: DataFrame, aliases: DataFrame | None = None, name: str = "name", target: str = "target", form: str = "form") -> DataFrame:
    """(name, target, form, pass_no): the panel's (target, form) rows for each distinct name, by the first pass that finds any.

    Passes: 1 alias (aliases: (alias, target), both lower case), 2 name without brackets, 3 whole name, 4 base name, 5 base
    name with / as and, 6 targets that begin with the base name's words (combinations only for combinations), 7 base
    name without its last salt, 8 with an added salt, the first that exists, 9 best share of common words, 0.67 at least,
    or all of a single one. Targets whose form the name hints at go before the others. Names without a match have no row.
    """
    low = F.regexp_replace(F.lower(F.trim(F.col(name))), r"\s+", " ")
    n = names.select(name).where(F.col(name).isNotNull()).distinct()
    plain = N.squeeze(F.regexp_replace(low, r"\([^)]*\)", ""))
    n = cut(n.withColumns({"low": low, "plain": plain, "base": N.base_name(N.squeeze(F.col(name)))}))
    forms = panel.select(F.lower(F.trim(F.col(target))).alias("key"), F.col(target).alias("target"), F.col(form).alias("form")).distinct()
    keys = cut(forms.select("key").distinct())
    # what a name may look up: (kind of entry, text, pass, order within the pass)
    probe = lambda kind, text, no, at=0: F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(no).alias("pass_no"), F.lit(at).alias("at"))
    base, at_dose = F.col("base"), r"\s+\d+\s*(mg|mcg|ml|%)\b.*$"
    bare = F.trim(F.regexp_replace(base, r"\s+(" + "|".join(N.SALT_TAILS) + r")\s*$", ""))
    tries = [
        *[probe("alias", x, 1, i) for i, x in enumerate((F.col("low"), F.col("plain"), F.trim(F.regexp_replace("low", at_dose, "")), F.trim(F.regexp_replace("plain", at_dose, ""))))],
        probe("key", F.col("plain"), 2),
        probe("key", F.col("low"), 3),
        probe("key", base, 4),
        probe("key", F.when(base.contains("/"), F.regexp_replace(base, r"\s*/\s*", " and ")), 5),
        probe("head", F.when(F.length(base) >= 4, base), 6),
        probe("key", F.when(bare != base, bare), 7),
        *[probe("key", F.concat(base, F.lit(f" {salt}")), 8, i) for i, salt in enumerate(N.ADDED_SALTS)],
    ]
    own = _words(F.when(base != "", base).otherwise(F.col("low")), ",/()-")
    rare = F.array_except("own", F.array(*map(F.lit, COMMON_WORDS)))
    words = F.transform(F.when(F.size(rare) > 0, rare).otherwise(F.col("own")), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("text"), F.lit(9).alias("pass_no"), F.lit(0).alias("at")))
    asked = n.withColumn("own", own).select(name, "base", "own", F.explode(F.concat(F.array(*tries), words)).alias("x")).select(name, "base", "own", "x.*").where(F.col("text").isNotNull())
    # what can be found: keys, every run of words that begins one, their words, and aliases with or without a key
    theirs, parts = _words(F.col("key"), ",()"), F.split("key", " ")
    entry = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: entry("head", F.array_join(F.slice(parts, F.lit(1), i), " ")))
    entries = F.concat(F.array(entry("key", F.col("key"))), heads, F.transform(theirs, lambda w: entry("word", w)))
    index = keys.select("key", theirs.alias("theirs"), F.lit(True).alias("known"), F.explode(entries).alias("x")).select("x.*", "key", "theirs", "known")
    if aliases is not None:
        named = aliases.select(F.lit("alias").alias("kind"), F.col("alias").alias("text"), F.col("target").alias("key"), F.lit(None).cast("array<string>").alias("theirs"))
        index = index.unionByName(named.join(keys.withColumn("known", F.lit(True)), "key", "left"), allowMissingColumns=True)
    found = asked.join(index, ["kind", "text"])
    found = found.where((F.col("pass_no") != 6) | base.contains(" and ") | ~F.col("key").contains(" and "))
    share = F.size(F.array_intersect("own", "theirs")) / F.greatest(F.size("own"), F.size("theirs"))
    found = found.withColumn("at", F.when(F.col("pass_no") == 9, -share).otherwise(F.col("at")))
    found = found.where((F.col("pass_no") != 9) | (-F.col("at") >= F.when(F.size("own") >= 2, 0.67).otherwise(1.0)))
    each = Window.partitionBy(name)
    # the first alias decides, even if its target is unknown
    alias = F.min(F.when(F.col("pass_no") == 1, F.col("at"))).over(each)
    found = found.withColumn("__a", alias).where((F.col("pass_no") != 1) | ((F.col("at") == F.col("__a")) & F.coalesce("known", F.lit(False))))
    order = F.struct("pass_no", "at")
    found = found.withColumn("__first", F.min(order).over(each)).where(order == F.col("__first")).select(name, "key", "pass_no")
    hits = found.join(forms, "key").join(n.select(name, N.form_hints(F.col("low")).alias("__hints")), name)
    return keep_hits(hits, [name], F.exists("__hints", lambda h: F.upper(F.col("form")).contains(h))).select(name, "target", "form", "pass_no").distinct()
