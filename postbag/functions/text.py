"""String, name and file-name functions as columns; nulls stay null unless said."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postbag.functions import names
from postbag.functions.porter import let

# Word lists and limits that results depend on.
TITLES = ["mr", "mrs", "ms", "dr", "prof", "sir"]
DOCUMENT_EXT = ["doc", "docx", "pdf", "ppt", "pptx", "txt", "rtf", "xls", "xlsx", "html", "htm"]
IMAGE_EXT = ["jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff"]
OFFICE_EXT = ["doc", "docx", "xls", "xlsx", "ppt", "pptx"]
ARCHIVE_EXT = ["zip", "gz", "tgz", "tar", "7z", "rar"]
JOIN_WORDS = ["and", "for", "in", "of", "on", "the", "to", "a", "an", "de", "van", "von", "la"]
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]


def clean_email(c: Column) -> Column:
    """Trimmed, lower-cased, without quotes around it."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^[\s'\"]+", ""), r"[\s'\"]+$", "")


def clean_person_name(c: Column, banned_words: list[str] = names.BANNED_WORDS, banned_parts: list[str] = names.BANNED_PARTS) -> Column:
    """A display name without quotes around it and without what stands in round or square
    brackets; null if nothing alphabetic or something banned is in it.  An address in its
    place is lower-cased."""
    def unquoted(one: Column, quotes: str) -> Column:
        if not quotes:
            return let(F.trim(F.regexp_replace(one, r"\([^)]*\)|\[[^\]]*\]", "")), lambda bare: judged(one, bare))
        inside = (F.length(one) >= 2) & one.startswith(quotes[0]) & one.endswith(quotes[0])
        return let(F.when(inside, F.substring(one, F.lit(2), F.length(one) - 2)).otherwise(one), lambda x: unquoted(x, quotes[1:]))

    def judged(one: Column, bare: Column) -> Column:
        def allowed(plain: Column) -> Column:
            banned = F.exists(F.split(F.lower(plain), " "), lambda w: w.isin(banned_words))
            for part in banned_parts:
                banned = banned | F.contains(F.lower(bare), F.lit(part))
            return F.when(~banned, plain)

        return F.when(~one.rlike(r"\p{L}"), None).when(F.instr(bare, "@") > 0, F.lower(bare)).otherwise(let(F.trim(F.regexp_replace(bare, r"\s+", " ")), allowed))

    return let(F.trim(c), lambda one: unquoted(one, "'\""))


def name_key(c: Column, variants: dict[str, str] = names.VARIANTS) -> Column:
    """Look-up key of a person name: lower-cased words, initials dropped when two longer words
    are left, sorted, each then as the name that it is a variant of.  A single word stays as it is."""
    words_ = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(clean_person_name(c), F.lit(""))), r"[.,]", " "), r"\s+"), lambda w: w != "")
    # by first letter, then by name: a look-up goes through the keys one after the other
    by_letter: dict[str, list[str]] = {}
    for full, short in variants.items():
        for v in short.split():
            by_letter.setdefault(v[0], []).extend((v, full))
    pairs = F.create_map(*[x for k, kv in by_letter.items() for x in (F.lit(k), F.create_map(*map(F.lit, kv)))]) if by_letter else None
    told = lambda w: F.coalesce(pairs[F.substring(w, 1, 1)][w], w) if by_letter else w

    def joined(words: Column) -> Column:
        def several(long_: Column) -> Column:
            kept = F.when((F.size(words) > 2) & (F.size(long_) >= 2), long_).otherwise(words)
            return F.array_join(F.transform(F.array_sort(kept), told), " ")

        return F.when(F.size(words) <= 1, F.array_join(words, " ")).otherwise(let(F.filter(words, lambda w: F.length(w) > 1), several))

    return let(words_, joined)


def entity_key(c: Column) -> Column:
    """Canonical form of an entity name: lower case, split at punctuation, sorted."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(c), r"[\s\".;,\-#@&()]+"), lambda w: w != "")), " ")


def bare_subject(c: Column) -> Column:
    """Subject without reply, forward and short [list] prefixes."""
    return F.regexp_replace(c, r"(?i)^(\s*((re|fwd?)\s*:|\[[^\]]{0,19}\]))+\s*", "")


def normal_subject(c: Column) -> Column:
    """Lower-cased, one reply prefix removed."""
    return F.trim(F.regexp_replace(F.lower(c), r"^\s*re\s*:\s*", ""))


def mask_email(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\s@<>\"']+@[^\s@<>\"']+", "...@...")


def mask_domain(c: Column) -> Column:
    return F.regexp_replace(c, r"([^\s@<>\"']+)@[^\s@<>\"']+", "$1@...")


def ellipsize(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n - 3), F.lit("...")))


def pad_width(c: Column, n: int) -> Column:
    return F.when(F.length(c) >= n, c).otherwise(F.rpad(c, n, " "))


def capitalize_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}\s]", "")


def strip_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"[\[\](){}<>]", "")


def acronym(c: Column) -> Column:
    """Initials of the capitalised words of a phrase."""
    return F.array_join(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w.rlike(r"^\p{Lu}")), lambda w: F.substring(w, 1, 1)), "")


def all_upper(c: Column) -> Column:
    return c.rlike(r"\p{L}") & (c == F.upper(c))


def extension(c: Column) -> Column:
    """Lower-cased extension of 1 to 5 characters, not of a name that starts with its dot."""
    e = F.regexp_extract(c, r"^.+\.([^./\\]{1,5})$", 1)
    return F.when(e != "", F.lower(e))


def base_name(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^./\\]{1,5}$", "")


def path_tail(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)[/\\]?$", 1)


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def url_tail(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"([^/]*)/?$", 1)


def top_level_domain(c: Column) -> Column:
    """Last two labels of a host name."""
    return F.regexp_extract(F.regexp_replace(c, r"^[a-z]+://|[/:?#].*$", ""), r"([^.]+\.[^.]+)$", 1)


def file_class(ext: Column) -> Column:
    e = F.lower(ext)
    return F.when(e.isin(IMAGE_EXT), "image").when(e.isin(OFFICE_EXT), "office").when(e.isin(DOCUMENT_EXT), "document").when(e.isin(ARCHIVE_EXT), "archive").otherwise("other")


def original_content(c: Column) -> Column:
    """A message without what it quotes: ends at a reply line, rule or forward mark;
    quoted lines become ` . `."""
    lines = F.split(c, r"\r?\n")
    ends = lambda x: F.trim(x).rlike(r"(?i)^on .*wrote:$|^_{4,}|^-+ ?(original|forwarded) message|^begin forwarded message")
    flags = F.transform(lines, ends)
    first = F.array_position(flags, True)
    kept = F.when(first > 0, F.slice(lines, 1, F.greatest(first.cast("int") - 1, F.lit(0)))).otherwise(lines)
    return F.array_join(F.transform(kept, lambda x: F.when(F.ltrim(x).startswith(">"), F.lit(" . ")).otherwise(x)), "\n")


def html_unescape(c: Column) -> Column:
    out = c
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def html_escape(c: Column) -> Column:
    out = c
    for k, v in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def html_text(c: Column) -> Column:
    """Visible text of an HTML page: scripts, styles, comments and tags removed, entities resolved."""
    body = F.regexp_replace(c, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(html_unescape(F.regexp_replace(body, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def links(c: Column) -> Column:
    """Distinct http and https addresses, trailing punctuation removed."""
    found = F.regexp_extract_all(c, F.lit(r"(https?://[^\s<>\"']+)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?)\]]+$", "")))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"[\s\"]+"), lambda w: w != "")


def word_pairs(c: Column) -> Column:
    """Neighbouring words, those with a join word left out."""
    w = words(c)
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: i + 1 < F.size(w)), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b")))
    no_join = lambda x: ~F.lower(x).isin(JOIN_WORDS)
    return F.transform(F.filter(pairs, lambda p: no_join(p.a) & no_join(p.b)), lambda p: F.concat_ws(" ", p.a, p.b))


def whole_word(text: Column, term: str) -> Column:
    """The term stands in the text with no letter on either side."""
    import re

    return text.rlike(r"(?<!\p{L})" + re.escape(term) + r"(?!\p{L})")


def split_values(value: str) -> list[str]:
    """Values of a query parameter: split at ;, trimmed, lower-cased."""
    return [x for x in (p.strip().lower() for p in value.split(";")) if x]


def scripts(c: Column) -> Column:
    """Languages told by Unicode script; English is always among them."""
    # Script and the language it stands for.
    table = {"Arabic": "arabic", "Armenian": "armenian", "Bengali": "bengali", "Cyrillic": "russian", "Devanagari": "hindi", "Georgian": "georgian", "Greek": "greek", "Gujarati": "gujarati", "Hangul": "korean", "Han": "chinese", "Hebrew": "hebrew", "Hiragana": "japanese", "Tamil": "tamil", "Telugu": "telugu", "Thai": "thai"}
    return F.array_compact(F.array(F.lit("english"), *[F.when(c.rlike(r"\p{Is" + k + "}"), v) for k, v in table.items()]))


def best_name_score(c: Column) -> Column:
    """Rank of a display name: several words, capital first letter, no comma, length."""
    w = F.split(F.trim(c), r"\s+")
    return (F.when(F.size(w) >= 2, 100).otherwise(0) + F.when(c.rlike(r"^\p{Lu}"), 10).otherwise(0) - F.when(F.instr(c, ",") > 0, 1).otherwise(0)) * 100 + F.length(c)


def login(c: Column) -> Column:
    return F.split_part(c, F.lit("@"), F.lit(1))


def organisation(c: Column) -> Column:
    """Second-level label of an address's domain."""
    return F.regexp_extract(F.split_part(c, F.lit("@"), F.lit(2)), r"([^.]+)\.[^.]+$", 1)


def last_name(c: Column) -> Column:
    return F.element_at(F.split(F.trim(c), r"\s+"), -1)


def name_match(a: Column, b: Column) -> Column:
    """How one name relates to another: CONTAINED, ACRONYM, CONTAINED_DIFFERENT_ORDER; null if equal or unrelated."""
    la, lb = F.lower(a), F.lower(b)
    wa, wb = F.split(la, r"\s+"), F.split(lb, r"\s+")
    return (
        F.when(la == lb, F.lit(None).cast("string"))
        .when(F.instr(F.concat(F.lit(" "), lb, F.lit(" ")), F.concat(F.lit(" "), la, F.lit(" "))) > 0, "CONTAINED")
        .when(all_upper(a) & (a == acronym(b)), "ACRONYM")
        .when(F.size(F.array_except(wa, wb)) == 0, "CONTAINED_DIFFERENT_ORDER")
    )


def signature(date: Column, *parts: Column) -> Column:
    """Identity of a message: sha256 of its date to the minute and its header fields."""
    return F.sha2(F.concat_ws("\x01", F.date_format(date, "yyyy-MM-dd HH:mm"), *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def size_bucket(size: Column) -> Column:
    """Facet code of a size in bytes; half-open bounds at 5 KB, 20 KB, 100 KB and 2 MB."""
    kb = 1024
    return F.when(size < 5 * kb, 1).when(size < 20 * kb, 2).when(size < 100 * kb, 3).when(size < 2048 * kb, 4).otherwise(5)


def in_size_bucket(size: Column, code: int) -> Column:
    """Filter form of the same buckets, bounds included on both sides; other codes pass."""
    kb = 1024
    bounds = {1: (None, 5 * kb - 1), 2: (5 * kb, 20 * kb), 3: (20 * kb, 100 * kb), 4: (100 * kb, 2048 * kb), 5: (2048 * kb, None)}
    if code not in bounds:
        return F.lit(True)
    low, high = bounds[code]
    return (F.lit(True) if low is None else size >= low) & (F.lit(True) if high is None else size <= high)


def looks_sane(c: Column) -> Column:
    """No run without white space of more than 1,000 characters."""
    return ~F.coalesce(c, F.lit("")).rlike(r"[^\s]{1001,}")


def canonical_variant(c: Column, variants: dict[str, str]) -> Column:
    """The last name of a chain of variants (nickname to full name); a loop ends where it
    would begin again.  Chains are followed when the expression is built."""
    ends = {}
    for start in variants:
        seen, now = {start}, variants[start]
        while now in variants and now not in seen:
            seen.add(now)
            now = variants[now]
        ends[start] = now
    if not ends:
        return c
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ends.items() for x in kv])[c], c)


def clean_content(c: Column) -> Column:
    """Content up to the first line that says `wrote:`, an opening quoted line dropped,
    blank lines as sentence ends, other line ends as spaces."""
    lines = F.split(c, "\n")
    first = F.array_position(F.transform(lines, lambda x: F.instr(x, "wrote:") > 0), True)
    kept = F.when(first > 0, F.slice(lines, 1, first.cast("int") - 1)).otherwise(lines)
    whole = F.concat(F.array_join(kept, "\n"), F.when(F.size(kept) > 0, "\n").otherwise(""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, "^>+.*", ""), "\n\n", ". "), "\n", " ")


def clean_name(c: Column) -> Column:
    """A candidate name without marks, possessive, field marks and greetings around it;
    null if a stop word or hyphen is in it."""
    n = F.regexp_replace(c, r"^\W+|\W+$", "")
    n = F.regexp_replace(F.regexp_replace(n, r"'s$", ""), r"\w+:\W+", "")
    n = F.regexp_replace(F.regexp_replace(n, r"([Dd]ear|[hH]i|[hH]ello)\W+", ""), r"^\W+|\W+$", "")
    stop = F.arrays_overlap(F.split(F.lower(n), r"\s+"), F.array(*map(F.lit, STOP_WORDS)))
    return F.when(~stop & (F.instr(n, "-") == 0), n)


def scrub_name(c: Column) -> Column:
    """A name on one line, without tags, braces and quotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"</?[A-Za-z]+[^>]*>", ""), r"[{}\"]", ""))


def prefixes(c: Column) -> Column:
    """All beginnings of a phrase, shortest first, in whole words."""
    w = F.split(F.trim(c), r"\s+")
    return F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, F.lit(1), i), " "))


def suffixes(c: Column) -> Column:
    """All ends of a phrase, longest first, in whole words."""
    w = F.split(F.trim(c), r"\s+")
    return F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, i, F.size(w)), " "))


def phrase_parts(c: Column) -> Column:
    """Distinct runs of whole words of a phrase."""
    w = F.split(F.trim(c), r"\s+")
    runs = F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(i, F.size(w)), lambda j: F.array_join(F.slice(w, i, j - i + 1), " ")))
    return F.array_distinct(F.flatten(runs))


def alternate_emails(c: Column) -> Column:
    """Addresses of a list at commas, spaces or tabs, lower-cased, each once."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[\t ,]+"), lambda x: x != ""))


def any_part(c: Column, query: str) -> Column:
    """The lower-cased text holds one of the parts of a query at `|`."""
    parts = [p.strip() for p in query.split("|") if p.strip()]
    out = F.lit(False)
    for p in parts:
        out = out | (F.instr(F.lower(c), p) > 0)
    return out


def number_tokens(c: Column) -> Column:
    """Lower-cased tokens that keep numbers whole: digits with separators, signs and dashes
    inside, else runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+(?:[.,:/-][0-9]+)+|[\p{L}\p{N}]+)"), 1)


def number_words(text: str) -> list[str]:
    """What `number_tokens` gives for one text."""
    return re.findall(r"[0-9]+(?:[.,:/-][0-9]+)+|[^\W_]+", text.lower())


def untitled(c: Column) -> Column:
    """A name without titles before it, and with `Last, First` turned round."""
    bare = F.regexp_replace(F.trim(c), "(?i)^((" + "|".join(TITLES) + r")\b\.?\s+)+", "")
    return F.regexp_replace(bare, r"^([^,]+), ([^,]+)$", "$2 $1")


def may_merge(a: Column, b: Column, common: list[str] | None = None) -> Column:
    """Two names may be one: equal without titles and with commas flipped, one the acronym
    of the other, or all words of the shorter among those of the longer, where a word cut
    by a dot stands for what it begins.  A shorter name of one word needs three letters
    and must not be one of the `common` words."""
    x, y = untitled(a), untitled(b)
    bag = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(F.regexp_replace(w, r"\.", "")) > 1))
    cut = lambda v, w: v.endswith(".") & w.startswith(F.substr(v, F.lit(1), F.length(v) - 1))
    stands = lambda v, w: (v == w) | cut(v, w) | cut(w, v)
    p, q = bag(x), bag(y)
    short, long = F.when(F.size(p) <= F.size(q), p).otherwise(q), F.when(F.size(p) <= F.size(q), q).otherwise(p)
    first = F.get(short, F.lit(0))
    lone = (F.length(first) >= 3) & ~first.isin(common or [""])
    within = (F.size(short) > 0) & F.forall(short, lambda v: F.exists(long, lambda w: stands(v, w))) & ((F.size(short) > 1) | lone)
    several = lambda c: F.instr(c, " ") > 0
    initials = (several(x) & ~several(y) & (acronym(x) == y)) | (several(y) & ~several(x) & (acronym(y) == x))
    return F.coalesce((F.length(x) > 1) & (F.length(y) > 1) & ((x == y) | initials | within), a.isNull() & b.isNull())
