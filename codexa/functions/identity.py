"""Keys, designations, versions, numbering and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """Without white space, Unicode's included, at both ends; null as empty. Only a text with some at an end is searched."""
    x = F.coalesce(c, F.lit(""))
    ends = F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x)


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normalize_key(c: Column) -> Column:
    """The lookup slug of a name or code: lower case, everything but letters, digits and underscores one underscore."""
    s = F.regexp_replace(F.lower(stripped(c)), r"(?U)[^\w]+", "_")
    s = F.btrim(F.regexp_replace(s, "_+", "_"), F.lit("_"))
    return F.when(s == "", "unknown").otherwise(s)


def version_of_name(c: Column) -> Column:
    """The last group of exactly four digits, or null."""
    return F.try_element_at(F.filter(F.split(F.coalesce(c, F.lit("")), "[^0-9]+"), lambda x: F.length(x) == 4), F.lit(-1))


def version_id(name: Column, content_hash: Column) -> Column:
    return F.concat(normalize_key(name), F.lit("__sha256_"), F.substring(content_hash, 1, 12))


def span_id(doc_id: Column, start: Column, end: Column) -> Column:
    """Null if either end is."""
    return F.concat(doc_id, F.lit(":span:"), start.cast("string"), F.lit(":"), end.cast("string"))


def aliases(name: Column, external: Column) -> Column:
    """The name and the external ids' values, trimmed, distinct and sorted."""
    values = F.concat(F.array(name), F.coalesce(F.map_values(external), F.array()))
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, stripped), lambda x: x != "")))


def lookup_keys(name: Column, external: Column) -> Column:
    """The name's slug; of each external id the value, its slug and kind:value."""

    def of(e: Column) -> Column:
        v = stripped(e["value"])
        return F.when(v == "", F.array().cast("array<string>")).otherwise(F.array(v, normalize_key(v), F.concat(e["key"], F.lit(":"), v)))

    each = F.coalesce(F.transform(F.map_entries(external), of), F.array().cast("array<array<string>>"))
    return F.array_sort(F.array_distinct(F.concat(F.array(normalize_key(name)), F.flatten(each))))


def normalize_designation(c: Column) -> Column:
    return F.btrim(F.upper(collapsed(c)), F.lit(" .,;:"))


def normalize_numbering(c: Column) -> Column:
    """The first dotted number, else the text without punctuation at its ends."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"[0-9]+(?:\.[0-9]+)*", 0)
    return F.when(found != "", found).otherwise(F.btrim(stripped(c), F.lit(" .,;:)")))


#: Prefixes of regulatory designations; the two-word ones are tried before the one-word ones they begin with.
PREFIXES = ("ТР ЕАЭС", "ТР ТС", "ГОСТ Р", "ГОСТ", "ВСН", "МДС", "НПБ", "ОДМ", "ППБ", "ПУЭ", "РД", "СанПиН", "СНиП", "СН", "СП", "СТО", "ТСН", "ФЗ")
DESIGNATION = r"(?iu)(?:" + "|".join(p.replace(" ", r"\s+") for p in PREFIXES) + r")\s*[0-9][0-9.\-]*(?:[-\s][0-9]{4})?"
CLAUSE = r"(?iu)(?:пункт[а-я]*|подпункт[а-я]*|раздел[а-я]*|разд\.?|глав[а-я]*|гл\.?|п\.?)\s*([0-9]+(?:\.[0-9]+)*)"


def designations(c: Column) -> Column:
    """All designations in a text, in order."""
    return F.regexp_extract_all(c, F.lit(DESIGNATION), 0)


def clause(c: Column) -> Column:
    """The first clause number a text names, or null."""
    found = F.regexp_extract(c, CLAUSE, 1)
    return F.when(found != "", found)


def numbering_rank(c: Column) -> Column:
    """How many parts a dotted number has: 1 to 6 parts of digits, none of 4 digits or more; else null."""
    parts = F.split(F.btrim(F.regexp_replace(stripped(c), r"[.)]+$", "")), r"\.")
    return F.when(F.forall(parts, lambda p: p.rlike("^[0-9]{1,3}$")) & F.size(parts).between(1, 6), F.size(parts))


def strip_numbering(text: Column, numbering: Column) -> Column:
    """text without its own leading number; unchanged where nothing else would be left or the number goes on."""
    rest = F.regexp_replace(text, F.concat(F.lit(r"(?U)^\s*\Q"), numbering, F.lit(r"\E(?![\w.])[.)\s]*")), F.lit(""))
    return F.when(F.coalesce(numbering, F.lit("")) == "", text).when(stripped(rest) == "", text).otherwise(rest)


_KINDS = {
    "appendix": "приложение", "bibliography": "references литература", "chapter": "глава part раздел", "clause": "point пункт", "conclusion": "заключение", "introduction": "введение intro",
    "list_item": "enumeration item", "preface": "предисловие foreword", "section": "подраздел subsection", "subclause": "подпункт", "title_page": "titlepage cover title", "toc": "table_of_contents содержание contents",
}
KIND_OF = {word: kind for kind, line in _KINDS.items() for word in line.split()}


def categorize(c: Column) -> Column:
    """A fragment's type with its synonyms folded; blank is a paragraph."""
    t = F.translate(F.lower(stripped(c)), " -", "__")
    table = F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])
    return F.when(t == "", "paragraph").otherwise(F.coalesce(F.try_element_at(table, t), t))


def clean_tags(c: Column) -> Column:
    """Trimmed, lower case, blanks dropped; order and repeats stay."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(stripped(x))), lambda x: x != "")


_SHORT = {"спб": "санкт-петербург", "питер": "санкт-петербург", "мск": "москва", "подмосковье": "московская область", "мособласть": "московская область", "ленобласть": "ленинградская область"}


def normalize_territory(c: Column) -> Column:
    """A territory's name in lower case without punctuation, contractions spelt out."""
    s = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]+", " "), r"(?U)\s+", " "))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _SHORT.items() for x in kv]), s), s)


def level_of(depth: Column) -> Column:
    """federal, regional or municipal, by depth in the territory tree."""
    return F.when(depth <= 1, "federal").when(depth == 2, "regional").otherwise("municipal")


def block_hash(c: Column) -> Column:
    return F.sha2(collapsed(c), 256)


def label(numbering: Column, text: Column) -> Column:
    """A breadcrumb's step: number and text, 60 characters at most."""
    return F.substring(stripped(F.concat(F.coalesce(numbering, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))), 1, 60)


def disambiguated(version: Column, existing: Column, content_hash: Column) -> Column:
    """The version, with a piece of the content's hash if another text has it already."""
    return F.when(F.array_contains(existing, version), F.concat(version, F.lit(" (ред. "), F.substring(content_hash, 1, 6), F.lit(")"))).otherwise(version)


def quoted(c: Column) -> Column:
    """Percent-encoded, slashes and spaces too."""
    e = F.url_encode(c)
    for a, b in ((r"\+", "%20"), (r"\*", "%2A"), ("%7E", "~")):
        e = F.regexp_replace(e, a, b)
    return e


def source_url(key: Column, name: Column, version: Column, user: Column, project: Column, scenario: Column) -> Column:
    """The link to a document's file: null without one; a user's own documents by project, else by scenario; otherwise shared."""
    path = F.concat(quoted(name), F.lit("/source"))
    own = F.concat(F.lit("/user-documents/"), path, F.lit("?user_id="), quoted(user))
    tail = F.concat(F.lit("version="), quoted(version))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(~has(key), F.lit(None).cast("string"))
        .when(has(user) & has(project), F.concat(own, F.lit("&project_id="), quoted(project), F.lit("&"), tail))
        .when(has(user) & has(scenario), F.concat(own, F.lit("&scenario_id="), quoted(scenario), F.lit("&"), tail))
        .otherwise(F.concat(F.lit("/documents/"), path, F.lit("?"), tail))
    )


def slug(c: Column) -> Column:
    """A collection-name part: lower-case letters and digits, everything else one underscore."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "_"), F.lit("_"))


def collection(base: str, model: Column, dim: Column) -> Column:
    return F.concat(F.lit(base + "__"), slug(model), F.lit("_"), dim.cast("string"))


def merged(document: Column, fragment: Column) -> Column:
    """Metadata of a document under that of its fragment, which wins."""
    d, f = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in (document, fragment))
    return F.map_concat(F.map_filter(d, lambda k, _: ~F.map_contains_key(f, k)), f)


def is_json_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
