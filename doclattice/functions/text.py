"""Scalar text functions as Column expressions: normalising, hashing, tokens, tags, citations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without weight in lexical overlap.
STOPWORDS = ("de", "la", "el", "en", "y", "a", "del", "los", "las", "un", "una", "por", "con", "para", "sistema", "activo", "ods1")

# Patterns of hazard terms in texts and in queries, of tags, codes, acronyms and tokens.
SAFETY_TERMS = r"\b(advertencia|precauci[oó]n|precauciones|peligro|atenci[oó]n|warning|caution|danger|nota de seguridad|riesgo|loto|bloqueo|seguridad de las personas|seguridad personal)\b"
SAFETY_QUERY = r"\b(seguridad|advertencia|precauci|peligro|bloqueo|loto|riesgo|antes de operar|procedimiento|paso a paso|cómo operar|safety|hazard)\b"
ASSET_TAG = r"\b[A-Z]{2,4}-\d{2,5}\b"
QUERY_TAG = r"\b[A-Z]{1,4}-\d{2,5}[A-Z0-9]*\b"
DOC_CODE = r"(?i)\b(?:SGP[A-Z0-9-]+|SGPD[A-Z0-9-]+|FRMGS-\d+|GUIGS-\d+|PROGS-\d+|NCC-?\d+)\b"
ACRONYM = r"(?i)\b(?:FMECA|GUIGS|PROGS|ATM|MRI|MSO|RCM|ENFR|ODS\d+|NCC)\b"
TOKEN = "[a-z0-9áéíóúüñ]+"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def normalize_text(text: Column) -> Column:
    """Lower case, trimmed, blank runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0b\f\r]+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_text(text), 256)


def file_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes; a text counts as UTF-8."""
    return F.sha2(content.cast("binary"), 256)


def block_hash(kind: Column, raw: Column, markdown: Column, headers: Column, rows: Column) -> Column:
    """Hash of a typed block; rows is an array of arrays."""
    return F.sha2(F.concat_ws("\n", kind, F.coalesce(raw, F.lit("")), F.coalesce(markdown, F.lit("")), F.array_join(headers, "|"), F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), "\n")), 256)


def count_pieces(text: Column) -> Column:
    """A token count that needs no vocabulary: words and punctuation runs."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[0-9A-Za-zÀ-ÿ]+|[^\s0-9A-Za-zÀ-ÿ]+"))


def tokenize(text: Column) -> Column:
    """Tokens longer than two characters that aren't stopwords, with repeats, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)
    return F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))


def token_count(text: Column) -> Column:
    """How many tokens ``tokenize`` finds, without making them."""
    low, stops = F.lower(text), "|".join(w for w in STOPWORDS if len(w) > 2)
    char = TOKEN[:-1]
    return F.regexp_count(low, F.lit(char + "{3,}")) - F.regexp_count(low, F.lit(f"(?<!{char})(?:{stops})(?!{char})"))


def token_rows(text: Column) -> Column:
    """The maximal runs of token characters as an array; of these, tokens are those of ``is_token``."""
    return F.split(F.lower(text), f"[^{TOKEN[1:-2]}]+")


def is_token(word: Column) -> Column:
    return (F.length(word) > 2) & ~word.isin(*STOPWORDS)


def asset_tags(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ASSET_TAG})"), 1)))


def exact_tags(text: Column) -> Column:
    """Equipment tags, document codes and acronyms in that order; of tags that differ in case only the first stays, as it is spelled."""
    every = F.concat(*[F.regexp_extract_all(text, F.lit(f"({p})"), 1) for p in (QUERY_TAG, DOC_CODE, ACRONYM)])
    kept = F.transform(F.array(every), lambda tags: F.filter(tags, lambda t, i: F.array_position(F.transform(tags, F.upper), F.upper(t)) == i + 1))
    return F.element_at(kept, 1)


def is_safety(text: Column) -> Column:
    return text.rlike("(?iu)" + SAFETY_TERMS)


def is_safety_query(text: Column) -> Column:
    return text.rlike("(?iu)" + SAFETY_QUERY)


def _decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """Of all characters of the basic plane whose compatibility form differs: what is left without combining marks, as one
    character or none, and as several of which one is a letter or digit of ASCII."""
    one, several = {}, {}
    for code in range(0xA0, 0xFFFF):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or (plain := unicodedata.normalize("NFKD", c)) == c and not unicodedata.combining(c):
            continue
        left = "".join(x for x in plain if not unicodedata.combining(x))
        if len(left) < 2:
            one[c] = left
        elif any(x.isascii() and x.isalnum() for x in left):
            several[c] = left
    return one, several


def strip_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks, as far as letters and digits of ASCII come of it."""
    one, several = _decompositions()
    gone = [c for c, x in one.items() if not x]
    kept = {c: x for c, x in one.items() if x}
    plain = F.translate(text, "".join(kept) + "".join(gone), "".join(kept.values()))
    table = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    ascii_only = ~text.rlike(r"[^\x00-\x7F]")
    return F.when(ascii_only, text).when(plain.rlike("[" + "".join(several) + "]"), spelled).otherwise(plain)


def key_part(text: Column) -> Column:
    """Accents off, lower case, other than letters and digits as one space; null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", " ")), F.lit(""))


# Forms of revisions and dates in file names.
NAME_REVISION = r"(?iU)\b(rev\.?\s*[a-z0-9]+|revision\s*[a-z0-9]+)\b"
NAME_DATE = r"(?U)\b(20\d{2}[-_/]?\d{2}[-_/]?\d{2}|\d{2}[-_/]\d{2}[-_/]20\d{2})\b"


def stem_of(name: Column) -> Column:
    """The last part of a path without its last suffix; a name that only starts with a full stop has none."""
    last = F.regexp_extract(name, r"([^/]*)/*$", 1)
    return F.regexp_replace(last, r"(?s)^(.+)\.[^.]+$", "$1")


def title_key(name: Column) -> Column:
    """File stem without revision and date parts."""
    bare = F.regexp_replace(F.regexp_replace(stem_of(name), NAME_REVISION, " "), NAME_DATE, " ")
    return key_part(bare)


def longest_tag(name: Column) -> Column:
    """The longest tag-like candidate of four characters at least that isn't a revision; the first of equals."""
    found = F.filter(F.regexp_extract_all(F.upper(name), F.lit(r"([A-Z]{2,4}-\d{2,5}[A-Z]?)"), 1), lambda t: (F.length(t) >= 4) & ~t.startswith("REV"))
    return F.element_at(F.array_sort(F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))), 1)["t"]


# Forms of document codes, guide numbers and asset tags in names, module and vendor words, folders that name no module.
NAME_CODE = r"(?i)\b([A-Z]{2,5}-\d{2}[A-Z0-9]{0,4}-[A-Z0-9-]{4,}|SGP-\d+MYC-[A-Z]+-\d+|NCC-\d+|IFC-\d+)\b"
GUIDE_NUMBER = r"(?i)\b(GUIGS|GUIG|PROGS|SOP)[-_ ]?(\d+)\b"
NAME_ASSET = r"\b([A-Z]{1,4}[-_ ]?\d{1,3}[-_ ]?[A-Z]{0,3}[-_ ]?\d{0,3})\b"
MODULES = ("DCH", "MYC", "ENF", "MRI", "MSO", "SPCI", "DRT", "GPRO", "M&C", "MC", "ELECTRICO", "MECANICO")
VENDORS = ("siemens", "schneider", "abb", "honeywell", "emerson", "rockwell", "ge", "metso", "flsmidth")
NO_MODULE = ("entregables", "anexos", "check list", "guia", "norma")


def _first_filled(*found: Column) -> Column:
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit(""))


def document_code(name: Column, path: Column) -> Column:
    """The document code of a file's name, else of its relative path, upper-cased."""
    return F.upper(_first_filled(*[F.regexp_extract(F.coalesce(c, F.lit("")), NAME_CODE, 1) for c in (name, path)]))


def guide_number(name: Column, path: Column) -> Column:
    of = lambda c: F.when(F.coalesce(c, F.lit("")).rlike(GUIDE_NUMBER), F.concat(F.upper(F.regexp_extract(c, GUIDE_NUMBER, 1)), F.lit("-"), F.regexp_extract(c, GUIDE_NUMBER, 2)))
    return F.coalesce(of(name), of(path), F.lit(""))


def module_of(name: Column, path: Column) -> Column:
    """The first module word in path and name (ampersands apart), else the first telling folder, 40 characters at most."""
    every = F.replace(F.upper(F.concat_ws(" ", path, name)), F.lit("&"), F.lit(""))
    known = F.coalesce(*[F.when(F.contains(every, F.lit(m.replace("&", ""))), m.replace("&", "")) for m in MODULES])
    folders = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), r"[\\/]"), key_part), lambda p: (F.length(p) >= 3) & ~p.isin(*NO_MODULE))
    return F.coalesce(known, F.substring(F.try_element_at(folders, F.lit(1)), 1, 40), F.lit(""))


def asset_of(name: Column, path: Column) -> Column:
    """The longest tag-like part of path and name, four characters at least and no revision; the first of equals."""
    found = F.transform(F.regexp_extract_all(F.upper(F.concat_ws(" ", path, name)), F.lit(NAME_ASSET), 1), lambda t: F.translate(t, " _", "--"))
    fit = F.filter(found, lambda t: (F.length(t) >= 4) & ~t.startswith("REV"))
    return F.coalesce(F.try_element_at(F.array_sort(F.transform(fit, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))), F.lit(1))["t"], F.lit(""))


def vendor_of(name: Column, path: Column) -> Column:
    every = F.lower(F.concat_ws(" ", path, name))
    return F.coalesce(*[F.when(F.contains(every, F.lit(v)), v) for v in VENDORS], F.lit(""))


def _filled(*parts: Column) -> Column:
    """The parts that aren't empty, between bars."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "|")


def _bars(key: Column) -> Column:
    return F.length(key) - F.length(F.replace(key, F.lit("|"), F.lit("")))


def logical_key(tenant: Column, origin: Column, kind: Column, name: Column, hint: Column | None = None, code: Column | None = None, guide: Column | None = None, asset: Column | None = None, module: Column | None = None, maker: Column | None = None, model: Column | None = None) -> Column:
    """The hint; else tenant, origin, code, asset, kind, module if there is a code; else the same with the guide number, if two of
    the others are there; else tenant, title, asset, maker, model, module. Empty parts are left out."""
    part = lambda c, default="": F.lit(default) if c is None else F.coalesce(F.nullif(key_part(c), F.lit("")), F.lit(default))
    who, source, what = part(tenant), part(origin, "ods1"), part(kind, "otro")
    tag, area, number, guide_no = part(asset), part(module), part(code), part(guide)
    titled = F.nullif(title_key(name), F.lit(""))
    by_code = F.when(number != "", _filled(who, source, number, tag, what, area))
    by_guide = _filled(who, source, guide_no, tag, what, area)
    by_title = _filled(who, F.coalesce(titled, part(name)), tag, part(maker), part(model), area)
    given = F.lit(None).cast("string") if hint is None else F.nullif(F.trim(hint), F.lit(""))
    return F.coalesce(given, by_code, F.when((guide_no != "") & (_bars(by_guide) >= 2), by_guide), F.nullif(by_title, F.lit("")), F.nullif(key_part(stem_of(name)), F.lit("")), F.lit("unknown"))


def identity_confidence(hint: Column, code: Column, guide: Column, asset: Column, module: Column, key: Column) -> Column:
    """high with a hint, a code, or guide number and asset; medium with guide number and module, or three bars in the key; else low."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.when(has(hint) | has(code) | (has(guide) & has(asset)), "high").when((has(guide) & has(module)) | (_bars(key) >= 3), "medium").otherwise("low")


def slug(name: Column, size: int = 60) -> Column:
    return F.substring(F.replace(F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", ""), F.lit(" "), F.lit("_")), 1, size)


def extract_slug(name: Column, size: int = 60) -> Column:
    """The slug under which extractions are kept: without full stops, underscores and blanks at its end."""
    return F.regexp_replace(slug(name, size), r"[._ ]+$", "")


def concept_slug(text: Column, size: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9áéíóúüñ \-]", "")), r"\s+", "-"), 1, size)


def decimal_comma(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def cited_indices(answer: Column, n: Column | None = None) -> Column:
    """Distinct numbers cited as [n], in order; those beyond n hits are dropped where n is given."""
    every = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("int")))
    return every if n is None else F.filter(every, lambda i: (i >= 1) & (i <= n))


def citation(title: Column, version: Column, page_start: Column, page_end: Column, section: Column, index: Column, kind: Column | None = None) -> Column:
    """Title (version), then pages, else section (sheet and row of a table), else fragment number."""
    blank = lambda c: F.nullif(c, F.lit(""))
    head = F.concat(F.coalesce(blank(title), F.lit("Documento")), F.coalesce(F.concat(F.lit(" ("), blank(version), F.lit(")")), F.lit("")))
    several = (F.coalesce(page_end, F.lit(0)) != 0) & (page_end != page_start)
    pages = F.when(several, F.concat(F.lit(" — págs. "), page_start.cast("string"), F.lit("–"), page_end.cast("string"))).otherwise(F.concat(F.lit(" — pág. "), page_start.cast("string")))
    place = F.concat(F.when((F.lit("") if kind is None else kind) == "tabla", " — hoja/fila: ").otherwise(" — "), blank(section))
    return F.concat(head, F.coalesce(pages, place, F.concat(F.lit(" — fragmento #"), (index + 1).cast("string")), F.lit("")))


def uuid5_url(name: Column) -> Column:
    """Version-5 UUID in the URL namespace, from SHA-1 and the version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), -1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1024**2))


def longest_run(query: Column, title: Column) -> Column:
    """Longest run of consecutive query tokens that stand in the lower-cased title, as parts of it."""
    found = lambda t: F.contains(title, t)
    step = F.aggregate(query, F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), lambda acc, t: F.struct(F.when(found(t), acc["run"] + 1).otherwise(0).alias("run"), F.greatest(acc["most"], F.when(found(t), acc["run"] + 1).otherwise(0)).alias("most")))
    return step["most"]


def human_tokens(n: Column) -> Column:
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.format_string("%.1fk", n / 1000)).otherwise(F.format_string("%.2fM", n / 1_000_000))


def json_block(text: Column) -> Column:
    """The first to the last brace of an answer, without code fences; empty if there is none."""
    return F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(?s)(\{.*\})", 1)


def bounding_box(polygon: Column) -> Column:
    """Least and greatest of the x and y values of x, y, x, y, ..."""
    x, y = F.filter(polygon, lambda _, i: i % 2 == 0), F.filter(polygon, lambda _, i: i % 2 == 1)
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def markdown_table(headers: Column, rows: Column) -> Column:
    """Headers and rows (array of arrays) as a pipe table."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("/"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(headers, lambda _: F.lit(" --- ")), "|"), F.lit("|"))
    return F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n")


def suggest_kind(name: Column, extension: Column) -> Column:
    """Document type from a file's extension, then from words of its name."""
    n, has = F.lower(name), lambda *ws: F.lower(name).rlike("|".join(ws))
    return (
        F.when(extension.isin(".xlsx", ".xls", ".csv"), "tabla")
        .when(extension == ".pptx", "presentacion")
        .when(extension == ".docx", "guia")
        .when(has("sop", "procedimiento", "progs"), "sop")
        .when(has("guia", "guigs"), "guia")
        .when(has("norma", "ncc"), "norma")
        .when(has("fmeca", "rcm"), "tabla")
        .when(has("plano") | n.rlike(r"\d{3}[a-z]{2}-\d{5}"), "plano")
        .when(n.rlike(r"\bifc\b"), "sop")
        .when(extension == ".pdf", "manual_oem")
        .otherwise("otro")
    )


def picked_kind(name: Column, extension: Column) -> Column:
    """The document type as the corpus picker guesses it: without the rules for word files, drawings and codes."""
    plain = suggest_kind(name, F.when(extension == ".docx", ".other").otherwise(extension))
    return F.when(plain == "plano", F.when(extension == ".pdf", "manual_oem").otherwise("otro")).otherwise(plain)


def is_relevant(kind: Column, title: Column, content: Column, want_kind: Column, titles: Column, contents: Column, keywords: Column) -> Column:
    """Whether a hit answers a golden case: type, any title (in the title, else anywhere), any content, then keywords decide; false without criteria."""
    every = F.lower(F.concat_ws(" ", title, content))
    some = lambda words, where: F.exists(words, lambda w: F.contains(where, F.lower(w)))
    asked = lambda words: F.coalesce(F.size(words), F.lit(0)) > 0
    return (
        F.when(want_kind.isNotNull() & ~want_kind.eqNullSafe(kind), False)
        .when(asked(titles) & ~some(titles, F.lower(title)) & ~some(titles, every), False)
        .when(asked(contents) & ~some(contents, every), False)
        .when(asked(keywords), some(keywords, every))
        .otherwise(want_kind.isNotNull() | asked(titles) | asked(contents))
    )


# Domains by document type, document types of an index, labels of states.
DOMAINS = {"norma": "criticidad", "guia": "mantenibilidad", "sop": "mantenibilidad", "tabla": "mantenibilidad", "presentacion": "confiabilidad", "otro": "ingenieria"}
INDEX_KINDS = ("norma", "guia", "sop", "manual_oem", "tabla", "presentacion", "otro")
INDEX_LABELS = {"active": "Indexado", "indexed": "Indexado", "indexado": "Indexado", "duplicado": "Duplicado", "mismo_contenido": "Mismo contenido", "needs_review": "Identidad dudosa", "error": "Error índice"}
STATUS_LABELS = {"pendiente": "Pendiente", "pendiente_extractor": "Pendiente extractor", "pass": "OK — listo", "review": "Revisar", "reject": "Rechazado", "error": "Error extracción", "excluido": "Excluido"}


def looked_up(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def index_kind(raw: Column) -> Column:
    return F.when(raw.isin(*INDEX_KINDS), raw).otherwise("otro")


def domain(kind: Column) -> Column:
    return F.coalesce(looked_up(index_kind(kind), DOMAINS), F.lit("ingenieria"))


def index_label(state: Column) -> Column:
    return F.when(F.coalesce(state, F.lit("")) == "", "Pendiente índice").otherwise(F.coalesce(looked_up(state, INDEX_LABELS), state))


def status_label(state: Column) -> Column:
    return F.coalesce(looked_up(state, STATUS_LABELS), state)


def slide_hash(title: Column, section: Column, notes: Column, visual: Column, elements: Column) -> Column:
    """Hash of a slide over its title, section, notes, visual text and elements (array of arrays)."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (title, section, notes, visual)], F.array_join(F.flatten(elements), "\n")), 256)


def path_key(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("/"), F.lit("\\")))


def document_key(key: Column, title: Column, citation_: Column, doc_id: Column) -> Column:
    """The key, else the title (or citation, or id) without revision, upper-cased, 160 characters at most."""
    some = F.coalesce(*[F.nullif(c, F.lit("")) for c in (title, citation_, doc_id)], F.lit(""))
    bare = F.regexp_replace(some, r"(?iu)\b(rev\.?|versi[oó]n|version)\s*[a-z0-9.]+\b", "")
    bare = F.substring(F.upper(F.trim(F.regexp_replace(bare, r"\s+", " "))), 1, 160)
    return F.coalesce(F.nullif(F.trim(key), F.lit("")), F.nullif(bare, F.lit("")), F.nullif(doc_id, F.lit("")), F.lit("unknown"))


def folder_key(relative_path: Column) -> Column:
    """The first folder of a relative path, or a name for the root."""
    parts = F.filter(F.split(F.replace(relative_path, F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("(root)")


def engineering_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(\d{6,}-\d{5}-\d{3}[A-Za-z]{2}-\d{5})", 1), F.lit(""))


def clamp_percent(value: Column) -> Column:
    """0 to 100, 50 where it is no number."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(F.bround(value.try_cast("double")).cast("int"), F.lit(50))))


def valid_indices(raw: Column, n: Column) -> Column:
    """Distinct whole numbers from 1 to n of an array of strings, in order."""
    return F.array_distinct(F.filter(F.transform(raw, lambda x: x.try_cast("int")), lambda i: i.isNotNull() & (i >= 1) & (i <= n)))


def search_text(symptom: Column, asset: Column, module: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(F.trim(c), F.lit("")) for c in (symptom, F.concat(F.lit("activo "), F.nullif(F.trim(asset), F.lit(""))), module)])


def parsed_time(text: Column) -> Column:
    """A timestamp from ISO text, Z as UTC; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def days_since(text: Column, today: Column) -> Column:
    return F.coalesce(F.datediff(today, F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")), F.lit(0))


def effective_count(extension: Column, pages: Column, slides: Column, blocks: Column, rows: Column) -> Column:
    """The count that tells a file's size: pages, slides, blocks or rows by its format."""
    return F.coalesce(F.when(extension == ".pdf", pages).when(extension == ".pptx", slides).when(extension == ".docx", blocks).when(extension.isin(".xlsx", ".xls"), rows), pages, slides, blocks, rows, F.lit(0))


def evidence_line(index: Column, citation_: Column, content: Column, size: int = 3500) -> Column:
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), citation_, F.lit("\n"), F.substring(content, 1, size))
