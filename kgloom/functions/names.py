"""Normal forms of names, as column expressions. Null counts as empty."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import vocab

LEGAL = r"(?i)[\s,]+(?:" + "|".join(vocab.LEGAL_SUFFIXES) + r")\.?$"


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """The value of ``key`` in a small fixed table, else ``default`` (the key itself)."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]
    return F.coalesce(found, key if default is None else default)


def bind(body, *values: Column) -> Column:
    """``body`` of ``values``, each evaluated once however often ``body`` names it."""
    held = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.element_at(F.transform(F.array(held), lambda x: body(*[x[f"v{i}"] for i in range(len(values))])), 1)


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def norm_key(c: Column) -> Column:
    """Lower case, separators as one space, no punctuation; spaces that punctuation leaves behind stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[\s_\-]+", " "), r"[^\p{L}\p{N}_\s]", ""))


def norm_entity(c: Column) -> Column:
    """As ``norm_key``, with single spaces."""
    return F.regexp_replace(norm_key(c), r"\s+", " ")


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(norm_entity(c), "[^a-z0-9]+", "_"), F.lit("_"))


def is_root_key(key: Column) -> Column:
    return key.isin(*vocab.UL_NAMES) | key.startswith("ul llc")


def is_root(c: Column) -> Column:
    return is_root_key(norm_key(c))


def norm_company(c: Column) -> Column:
    out = text(c)
    for _ in range(3):
        out = F.rtrim(F.regexp_replace(F.regexp_replace(out, LEGAL, ""), r"[ ,.]+$", ""))
    return F.when(text(c) == "", "").when(is_root(c), "ul solutions").otherwise(norm_entity(out))


def company_core(c: Column) -> Column:
    """The normal form without legal forms at its end; empty if there is nothing else."""
    spaced = F.trim(F.regexp_replace(norm_key(c), r"\s+", " "))
    return F.regexp_replace(spaced, rf"(?:(?:^| )(?:{'|'.join(vocab.CORE_SUFFIXES)}))+$", "")


def norm_standard(c: Column) -> Column:
    return norm_entity(F.regexp_replace(text(c), r"(?i)\b([a-z]{2,4})[\s\-]*(\d)", "$1 $2"))


def clause_number(c: Column) -> Column:
    number = F.regexp_extract(text(c), r"(\d+(?:\.\d+)+|\d+)", 1)
    return F.when(number == "", norm_entity(c)).otherwise(number)


def graph_type(c: Column) -> Column:
    raw = F.regexp_replace(F.lower(F.when(text(c) == "", "entity").otherwise(text(c))), "[- ]", "_")
    return lookup(vocab.GRAPH_TYPE_ALIASES, raw)


def norm_for_type(kind: Column, name: Column) -> Column:
    kind = graph_type(kind)
    return (
        F.when((kind == "ul") & is_root(name), "ul solutions")
        .when(kind == "company", norm_company(name))
        .when(kind == "standard", norm_standard(name))
        .otherwise(norm_entity(name))
    )


def label(kind: Column) -> Column:
    kind = graph_type(kind)
    return F.when(kind == "ul", "UL").otherwise(F.regexp_replace(F.initcap(F.regexp_replace(kind, "[^a-zA-Z0-9]+", " ")), " ", ""))


def relation_type(c: Column) -> Column:
    out = F.upper(F.regexp_replace(text(c), "[^a-zA-Z0-9_]", "_"))
    return F.when(out == "", "RELATED_TO").otherwise(out)


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, " "), "")


def is_generic_org(c: Column) -> Column:
    w = words(norm_company(c))
    return (F.size(w) == 1) & F.get(w, F.lit(0)).isin(*vocab.GENERIC_ORG_WORDS, *vocab.WEAK_COMPANY_WORDS)


def _shorter_longer(a: Column, b: Column) -> tuple[Column, Column]:
    first = F.size(a) <= F.size(b)
    return F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)


def _same_company(a: Column, b: Column) -> Column:
    def test(a, b, s, t):
        rest = F.slice(t, F.size(s) + 1, F.greatest(F.size(t), F.lit(1)))
        weak = (F.size(s) == 1) & F.get(s, F.lit(0)).isin(*vocab.WEAK_COMPANY_WORDS)
        generic = F.size(F.array_except(rest, F.array(*[F.lit(w) for w in vocab.GENERIC_ORG_WORDS]))) == 0
        prefix = (F.slice(t, F.lit(1), F.size(s)) == s) & (F.size(rest) > 0) & generic & ~weak
        return (F.size(a) > 0) & (F.size(b) > 0) & ((a == b) | prefix)

    return bind(test, a, b, *_shorter_longer(a, b))


def companies_equivalent(a: Column, b: Column) -> Column:
    """Equal cores, or one core is the other with generic words behind, unless it is a single weak word."""
    return bind(_same_company, words(norm_company(a)), words(norm_company(b)))


def names_equivalent(a: Column, b: Column) -> Column:
    def test(x, y, firms):
        def suffix(s, t):
            return (F.size(s) >= 2) & (F.size(s) < F.size(t)) & (F.slice(t, F.greatest(F.size(t) - F.size(s), F.lit(0)) + 1, F.greatest(F.size(s), F.lit(1))) == s)

        return (F.size(x) > 0) & (F.size(y) > 0) & ((x == y) | firms | bind(suffix, *_shorter_longer(x, y)))

    return bind(test, words(norm_entity(a)), words(norm_entity(b)), companies_equivalent(a, b))


def preferred(a: Column, b: Column) -> Column:
    """The fuller of two display names; the left one on a tie."""

    def ranks(c):
        firm = lambda core, form: F.struct(((core != "") & (form != core)).cast("int"), F.size(F.filter(words(core), lambda w: w.isin(*vocab.GENERIC_ORG_WORDS))), F.length(c))
        return bind(firm, norm_company(c), norm_entity(c)), F.struct(F.size(words(norm_entity(c))), F.length(c))

    def pick(ta, tb):
        (fa, ra), (fb, rb) = ranks(ta), ranks(tb)
        left = F.when(companies_equivalent(ta, tb), fa >= fb).otherwise(ra >= rb)
        return F.when(ta == "", tb).when(tb == "", ta).when(left, ta).otherwise(tb)

    return bind(pick, text(a), text(b))


def canonical_id(kind: Column, name: Column, parent: Column | None = None) -> Column:
    """``type_slug``; products, models and clauses are qualified by their parent's id, if there is one."""

    def build(kind, within, own, root):
        nested = (within != "") & kind.isin("product", "model", "clause") & ~((kind == "product") & within.startswith("ul_"))

        def prefixed(ident):
            doubled = (ident == kind) | ident.startswith(F.concat(kind, F.lit("_")))
            return F.when(kind == "ul", "ul_solutions").when(doubled, ident).otherwise(F.concat(kind, F.lit("_"), F.when(ident == "", "unknown").otherwise(ident)))

        return bind(prefixed, F.when(root, "ul_solutions").otherwise(slug(F.when(nested, F.concat_ws("_", within, own)).otherwise(own))))

    def with_kind(kind, name):
        own = F.when(kind == "clause", clause_number(name)).otherwise(norm_for_type(kind, name))
        root = is_root(name) | norm_company(name).isin("ul", "ul solutions")
        return bind(build, kind, slug(parent) if parent is not None else F.lit(""), own, root)

    return bind(with_kind, graph_type(kind), text(name))


def short_description(c: Column, most_words: int = 18, most_chars: int = 140) -> Column:
    """One short sentence: spaces collapsed, the shortest part between bars, its first sentence, cut to size."""

    def shortest(raw):
        parts = F.filter(F.transform(F.split(raw, r"\s\|\s"), lambda p: F.trim(p)), lambda p: p != "")
        least = F.get(F.sort_array(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("p")))), F.lit(0))["p"]
        return F.when(F.contains(raw, F.lit(" | ")), F.coalesce(least, raw)).otherwise(raw)

    def sentence(raw):
        return bind(lambda first: F.when(first == "", raw).otherwise(first), F.regexp_extract(raw, r"^(.*?[.!?])(?:\s|$)", 1))

    def few_words(raw, w):
        return F.when(F.size(w) > most_words, F.concat(F.regexp_replace(F.array_join(F.slice(w, 1, most_words), " "), "[,;:-]+$", ""), F.lit("."))).otherwise(raw)

    def few_chars(raw):
        cut = F.regexp_replace(F.regexp_replace(F.substring(raw, 1, most_chars), r" [^ ]*$", ""), "[,;:-]+$", "")
        return F.when(F.length(raw) > most_chars, F.concat(cut, F.lit("."))).otherwise(raw)

    raw = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return bind(few_chars, bind(lambda x: few_words(x, F.split(x, " ")), bind(sentence, bind(shortest, raw))))


def with_short_description(t: DataFrame, c: str, most_words: int = 18, most_chars: int = 140) -> DataFrame:
    """``t`` with column ``c`` shortened as by ``short_description``, in steps that stay in generated code."""
    v = F.col("_short")
    parts = F.filter(F.transform(F.split(v, r"\s\|\s"), lambda p: F.trim(p)), lambda p: p != "")
    least = F.get(F.sort_array(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i"), p.alias("p")))), F.lit(0))["p"]
    cut = F.regexp_replace(F.regexp_replace(F.substring(v, 1, most_chars), r" [^ ]*$", ""), "[,;:-]+$", "")
    few = F.concat(F.regexp_replace(F.substring_index(v, " ", most_words), "[,;:-]+$", ""), F.lit("."))
    x = t.withColumn("_short", F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    x = x.withColumn("_short", F.when(F.contains(v, F.lit(" | ")), F.coalesce(least, v)).otherwise(v))
    x = x.withColumn("_first", F.regexp_extract(v, r"^(.*?[.!?])(?:\s|$)", 1)).withColumn("_short", F.when(F.col("_first") == "", v).otherwise(F.col("_first")))
    x = x.withColumn("_short", F.when(F.length(v) - F.length(F.replace(v, F.lit(" "))) >= most_words, few).otherwise(v))
    return x.withColumn(c, F.when(F.length(v) > most_chars, F.concat(cut, F.lit("."))).otherwise(v)).drop("_short", "_first")
