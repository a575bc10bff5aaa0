"""Firms that texts name, and the roles that texts speak for.

Chunks: project_id, document_id, chunk_id, seq (their order), source_file, text. Entities: project_id, seq, name, entity_type, description,
kinds (how texts name it; may be null). Triplets as in ``triplets``. A null project counts as the project of empty name, a null text as empty.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.functions import vocab
from kgloom.operators.components import written
from kgloom.operators.dedup import merged_texts
from kgloom.operators.extraction import ID, clean_company, plausible_company
from kgloom.operators.named import containing, small
from kgloom.operators.triplets import relation_of

FIRMS = ("company", "applicant", "brand")


def _project(t: DataFrame) -> DataFrame:
    return t.withColumn("project_id", F.coalesce("project_id", F.lit("")))


def _type(c: str) -> Column:
    return F.lower(N.text(F.col(c)))


def company_mentions(chunks: DataFrame) -> DataFrame:
    """One row for each firm that a chunk names: name, evidence, kinds in the order of the cues, and its place among the chunk's firms.

    Spellings of one firm share ``key``; of them one with a legal form wins, then the longest, then the first. Evidence that
    other evidence contains is left out. What follows happens within a chunk, so no group outgrows a text.
    """
    body = F.coalesce("text", F.lit(""))

    def hits(kind: str, flags: str, phrase: str, after: str) -> Column:
        pattern = F.lit(f"(?U{flags}){phrase}" + (f"(?={after})" if after else ""))
        both = F.arrays_zip(F.regexp_extract_all(body, pattern, 0).alias("evidence"), F.regexp_extract_all(body, pattern, 1).alias("name"))
        return F.transform(both, lambda h: F.struct(F.lit(kind).alias("kind"), h["evidence"].alias("evidence"), h["name"].alias("name")))

    found = _project(chunks).select(*ID, "seq", "source_file", F.posexplode(F.flatten(F.array(*[hits(*c) for c in vocab.FIRM_CUES]))).alias("place", "h"))
    found = found.select(*ID, "seq", "source_file", "place", "h.kind", F.trim(F.regexp_replace("h.evidence", r"\s+", " ")).alias("evidence"), clean_company(F.col("h.name")).alias("name"))
    found = found.where(plausible_company(F.col("name"))).withColumn("key", N.norm_company(F.col("name"))).where("key <> ''")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    rank = F.struct((bare != F.col("key")).alias("formal"), F.length("name").alias("length"), (-F.col("place")).alias("first"), "name")
    one = found.groupBy(*ID, "key").agg(F.min("seq").alias("seq"), F.min("source_file").alias("source_file"), F.min("place").alias("place"), F.max(rank)["name"].alias("name"), F.array_sort(F.collect_list(F.struct("place", "kind", "evidence"))).alias("all"))
    each = lambda field: F.array_distinct(F.transform("all", lambda h: h[field]))
    joined = F.aggregate(each("evidence"), F.lit(""), lambda a, e: F.when(F.contains(a, e), a).when(a == "", e).otherwise(F.concat(a, F.lit(" | "), e)))
    return one.select(*ID, "seq", "source_file", "place", "key", "name", joined.alias("evidence"), each("kind").alias("kinds"))


def merged_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with the firms that texts name: kinds and descriptions added to the first firm of the same core, a better name taken.

    A core without an entity becomes a company, without ``seq``. A name with a legal form beats one without, a longer
    one a shorter one, of equals the earlier stays. Which files name a firm: ``mention_files``.
    """
    e = _project(entities).withColumn("core", F.when(_type("entity_type").isin(*FIRMS), N.company_core(F.col("name"))))
    own = e.where("core <> ''").groupBy("project_id", "core").agg(F.min(F.struct("seq", "name", "entity_type", "description", "kinds")).alias("e"))
    none = F.array().cast("array<string>")
    at = (F.col("seq").cast("decimal(20,0)") * F.lit(1 << 31) + F.col("place")).cast("decimal(31,0)")
    said = mentions.withColumn("core", N.company_core(F.col("name"))).where("core <> ''").select("project_id", "core", at.alias("seq"), "name", F.col("evidence").alias("description"), "kinds")
    before = own.select("project_id", "core", F.lit(-1).cast("decimal(31,0)").alias("seq"), "e.name", "e.description", F.coalesce("e.kinds", none).alias("kinds"))
    rows = written(before.union(said))
    formal = N.company_core(F.col("name")) != N.norm_key(F.col("name"))
    named = rows.groupBy("project_id", "core").agg(F.max(F.struct(formal.alias("formal"), F.length("name").alias("length"), (-F.col("seq")).alias("first"), "name"))["name"].alias("name"), F.count_if(F.col("seq") >= 0).alias("said"))
    kinds = rows.select("project_id", "core", "seq", F.posexplode("kinds").alias("i", "kind")).groupBy("project_id", "core", "kind").agg(F.min(F.struct("seq", "i")).alias("at"))
    kinds = kinds.groupBy("project_id", "core").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda x: x["kind"]).alias("kinds"))
    texts = merged_texts(rows, ["project_id", "core"], "description", []).drop("seq")
    firms = named.where("said > 0").join(texts, ["project_id", "core"]).join(kinds, ["project_id", "core"], "left")
    mark = ["project_id", "core", "seq"]
    firms = firms.join(own.select("project_id", "core", "e.seq"), ["project_id", "core"], "left").select(*mark, *[F.col(c).alias(f"_{c}") for c in ("name", "description", "kinds")])
    either = lambda c: F.when(F.col("_name").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    # of firms with one core and place only the first is the one that was merged
    twin = F.row_number().over(Window.partitionBy(*mark).orderBy("name", "entity_type", "description"))
    firm = e.where("core <> ''").withColumn("twin", twin).join(firms.withColumn("twin", F.lit(1)), [*mark, "twin"], "left")
    columns = ["project_id", "seq", either("name"), "entity_type", either("description"), either("kinds")]
    other = e.where("core is null or core = ''").select("project_id", "seq", "name", "entity_type", "description", "kinds")
    new = firms.where("seq is null").join(own, ["project_id", "core"], "left_anti").select("project_id", "seq", F.col("_name").alias("name"), F.lit("company").alias("entity_type"), F.col("_description").alias("description"), F.col("_kinds").alias("kinds"))
    return other.unionByName(firm.select(columns)).unionByName(new)


def mention_files(mentions: DataFrame) -> DataFrame:
    """``project_id, core, source_file``: the files that name a firm, as rows, as they may be many."""
    x = mentions.select("project_id", N.company_core(F.col("name")).alias("core"), N.text(F.col("source_file")).alias("source_file"))
    return x.where("core <> '' and source_file <> ''").distinct()


def chunks_naming(texts: DataFrame, cores: DataFrame) -> DataFrame:
    """``project_id, id, core``: the texts (project_id, id, low) that contain a core (project_id, core) of their project.

    Every word of a core lies within a word of such a text. Core words meet the distinct words of the texts, by their rarest three characters; a core
    then meets texts by that of its words which fewest of the project's texts have, and is verified. Only words travel with ids, never texts.
    """
    # words as often as a text has them count once
    tokens = written(texts.select("project_id", "id", F.explode(F.array_distinct(F.filter(F.split("low", r"\s+"), lambda w: w != ""))).alias("word")))
    often = written(tokens.groupBy("project_id", "word").agg(F.count("*").alias("n")))
    asked = written(cores.select("project_id", "core").where("core <> ''").distinct())
    parts = asked.select("project_id", "core", F.explode(F.array_distinct(F.split("core", " "))).alias("text"))
    within = written(containing(parts.select("text"), often.select(F.col("word").alias("low")).distinct()).select("text", F.col("low").alias("word")))
    freq = often.join(small(within), "word").groupBy("project_id", "text").agg(F.sum("n").alias("n"))
    rarest = parts.join(freq, ["project_id", "text"], "left").groupBy("project_id", "core").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.min_by("text", F.struct("n", "text")).alias("text"))
    anchors = small(written(rarest.where("missing = 0").join(within, "text").select("project_id", "word", "core")))
    met = written(tokens.join(anchors, ["project_id", "word"]).select("project_id", "id", "core").distinct())
    return texts.join(met, ["project_id", "id"]).where(F.contains("low", "core")).select("project_id", "id", "core")


def spoken_roles(chunks: DataFrame, cores: DataFrame) -> DataFrame:
    """``project_id, core, applicant, manufacturer`` of the cores (project_id, core) that a chunk of their project contains: whether such a chunk
    speaks of the role. Equal texts are read once; chunks are judged alone, so a cue doesn't reach over two."""
    body = F.coalesce("text", F.lit(""))
    shaped = _project(chunks).select("project_id", N.norm_key(body).alias("low"), body.rlike(vocab.APPLICANT_CUES).alias("applicant"), body.rlike(vocab.MANUFACTURER_CUES).alias("manufacturer"))
    texts = written(shaped.withColumn("id", F.sha2("low", 256)).groupBy("project_id", "id").agg(F.first("low").alias("low"), F.bool_or("applicant").alias("applicant"), F.bool_or("manufacturer").alias("manufacturer")))
    met = chunks_naming(texts.select("project_id", "id", "low"), cores).join(texts.drop("low"), ["project_id", "id"])
    return met.groupBy("project_id", "core").agg(F.bool_or("applicant").alias("applicant"), F.bool_or("manufacturer").alias("manufacturer"))


def demoted_applicants(chunks: DataFrame, entities: DataFrame, triplets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and triplets in which an applicant that texts name, but never in that role or as an owner, is a company.

    Its applicant triplets go, other ends that bear its name as an applicant become companies.
    """
    e = _project(entities).withColumns({"core": N.company_core(F.col("name")), "kinds": F.coalesce("kinds", F.array().cast("array<string>"))})
    is_applicant = _type("entity_type") == "applicant"
    owner = F.arrays_overlap("kinds", F.array(*[F.lit(k) for k, *_ in vocab.FIRM_CUES]))
    silent = small(written(spoken_roles(chunks, e.where(is_applicant)).where("not applicant").select("project_id", "core", F.lit(True).alias("silent"))))
    judged = written(e.join(silent, ["project_id", "core"], "left").withColumn("demoted", is_applicant & F.col("silent").isNotNull() & ~owner).drop("silent"))
    mark = F.when(F.array_contains("kinds", "demoted_applicant"), F.col("kinds")).otherwise(F.array_append("kinds", F.lit("demoted_applicant")))
    new = judged.withColumns({"entity_type": F.when(F.col("demoted"), "company").otherwise(F.col("entity_type")), "kinds": F.when(F.col("demoted"), mark).otherwise(F.col("kinds"))})
    gone = small(written(judged.where("demoted").select("project_id", "core", F.lit(True).alias("gone")).distinct()))
    t = _project(triplets)
    for end in ("source", "destination"):
        t = t.withColumn(f"_{end}", N.company_core(F.col(f"{end}_node"))).join(gone.select("project_id", F.col("core").alias(f"_{end}"), F.col("gone").alias(f"_{end}_gone")), ["project_id", f"_{end}"], "left")
    t = t.where(~((relation_of(F.col("relationship")) == "party_role_applicant") & F.col("_destination_gone").isNotNull()))
    plain = {f"{end}_type": F.when((_type(f"{end}_type") == "applicant") & F.col(f"_{end}_gone").isNotNull(), "company").otherwise(F.col(f"{end}_type")) for end in ("source", "destination")}
    return new.drop("core", "demoted"), t.withColumns(plain).select(*triplets.columns)


def without_unspoken_manufacturers(chunks: DataFrame, triplets: DataFrame) -> DataFrame:
    """Triplets without those that call a firm a manufacturer though neither a text that names it nor their own evidence (``description``) does.

    A firm that no text names stays.
    """
    t = _project(triplets)
    firm = F.coalesce(F.when(F.col("destination_node") != "", F.col("destination_node")), F.col("source_node"))
    is_role = relation_of(F.col("relationship")) == "party_role_manufacturer"
    t = t.withColumn("core", F.when(is_role, N.company_core(firm)))
    silent = small(written(spoken_roles(chunks, t.where("core <> ''")).where("not manufacturer").select("project_id", "core", F.lit(True).alias("silent"))))
    kept = t.join(silent, ["project_id", "core"], "left").where(F.col("silent").isNull() | F.coalesce("description", F.lit("")).rlike(vocab.MANUFACTURER_CUES))
    return kept.select(*triplets.columns)
