"""Writers: archive tables, mailboxes, CSV, JSON, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postbag.sinks.shared import freeing_shuffles, move_parts, remove, shared_folder, size_of
from postbag.sources.mbox import ATTACHMENTS

#: Packed mail rows of this size together are one file of a mailbox.
FILE_BYTES = 4_000_000
#: More than this is sorted in rounds by date, so that not all of it stands in a shuffle at once; each round reads all packed rows, so they are few.
ROUND_BYTES, ROUNDS = 100_000_000, 4


def save_archive(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def address_line(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda a: F.when(a["name"].isNull(), a["email"]).otherwise(F.concat(F.lit('"'), a["name"], F.lit('" <'), a["email"], F.lit(">")))), ", ")


def _base64(c: Column) -> Column:
    return F.when(F.length(c) <= 57, F.base64(c)).otherwise(F.regexp_replace(F.regexp_replace(F.base64(c), r"\s", ""), "(.{76})(?=.)", "$1\n"))  # 57 bytes are one line


def _attached(a: Column) -> Column:
    """An attachment as a MIME part; a message that is text stays readable, all else is base64."""
    kind = F.concat(F.lit("Content-Type: "), F.coalesce(a["content_type"], F.lit("application/octet-stream")), F.when(a["charset"].isNotNull(), F.concat(F.lit('; charset="'), a["charset"], F.lit('"'))).otherwise(F.lit("")))
    name = F.replace(F.replace(F.url_encode(F.coalesce(a["filename"], F.lit("attachment"))), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    head = F.concat(kind, F.lit("\nContent-Disposition: attachment; filename*=utf-8''"), name, F.lit("\nContent-Transfer-Encoding: "))
    content = F.coalesce(a["content"], a["text"].cast("binary"), F.lit(b""))
    text = content.cast("string")
    readable = (a["content_type"] == "message/rfc822") & F.is_valid_utf8(text)
    return F.concat(head, F.when(readable, F.concat(F.lit("8bit\n\n"), text)).otherwise(F.concat(F.lit("base64\n\n"), _base64(content))))


def _multipart(kind: str, mark: Column, parts: Column) -> Column:
    """An array of parts as one part."""
    open_ = F.concat(F.lit("\n--"), mark, F.lit("\n"))
    head = F.concat(F.lit(f'Content-Type: multipart/{kind}; boundary="'), mark, F.lit('"\n\nThis is a multi-part message in MIME format.'))
    return F.concat(head, F.array_join(F.transform(parts, lambda x: F.concat(open_, x)), ""), F.lit("\n--"), mark, F.lit("--"))


def _texts() -> tuple[Column, Column]:
    return F.coalesce("body", F.lit("")), F.coalesce("text_html", F.lit(""))


def _mark() -> Column:
    """A mark made of the content's hash does not stand in the content."""
    return F.sha2(F.concat_ws("\x01", *_texts(), F.transform("attachments", lambda a: F.sha1(F.coalesce(a["content"], a["text"].cast("binary"))))), 256)


def _content(mark: Column) -> Column:
    """Plain text, HTML or both, with or without attachments: six kinds of content."""
    (body, html), files = _texts(), F.col("attachments")
    plain = F.concat(F.lit('Content-Type: text/plain; charset="utf-8"\n\n'), body)
    page = F.concat(F.lit('Content-Type: text/html; charset="utf-8"\nContent-Transfer-Encoding: base64\n\n'), _base64(html.cast("binary")))
    text = F.when(html == "", plain).when(F.coalesce("has_plain", F.lit(True)), _multipart("alternative", F.concat(F.lit("=_t"), mark), F.array(plain, page))).otherwise(page)
    return F.when(F.size(files) > 0, _multipart("mixed", F.concat(F.lit("=_m"), mark), F.concat(F.array(text), F.transform(files, _attached)))).otherwise(text)


def mbox_text(labels: bool = True, content: Column | None = None) -> Column:
    """A message as mailbox text, with folder, annotation and label headers, all text parts and attachments.

    The `content` is used more than once: a column that holds it saves making it again.
    """
    none = F.lit(None).cast("string")
    head = [
        F.concat(F.lit("From - "), F.coalesce(F.date_format("date", "EEE MMM dd HH:mm:ss yyyy"), F.lit(""))),  # without a date too, it parts two messages
        *[F.when(F.size(n) > 0, F.concat(F.lit(f"{t}: "), address_line(F.col(n)))).otherwise(none) for n, t in (("from", "From"), ("to", "To"), ("cc", "Cc"), ("bcc", "Bcc"))],
        F.concat(F.lit("Date: "), F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss Z")),
        F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit(""))),
        F.when(F.col("message_id").isNotNull(), F.concat(F.lit("Message-ID: "), F.col("message_id"))),
        F.concat(F.lit("X-Archive-Folder: "), F.col("folder")),
    ]
    if labels:
        head += [F.when(F.col("annotation") != "", F.concat(F.lit("X-Archive-Annotation: "), F.regexp_replace("annotation", r"\s+", " "))), F.when(F.size("label_names") > 0, F.concat(F.lit("X-Archive-Labels: "), F.array_join("label_names", "; ")))]
    content = _content(_mark()) if content is None else content
    content = F.when(content.contains("From "), F.regexp_replace(content, r"(?md)^(>*From )", ">$1")).otherwise(content)
    return F.concat(F.concat_ws("\n", *head, F.lit("MIME-Version: 1.0")), F.lit("\n"), content, F.lit("\n"))


def _with_parts(messages: DataFrame) -> DataFrame:
    for name, kind in (("has_plain", "boolean"), ("text_html", "string"), ("attachments", ATTACHMENTS)):
        if name not in messages.columns:
            messages = messages.withColumn(name, F.lit(None).cast(kind))
    return messages


def _mail_rows(messages: DataFrame, labels: bool) -> DataFrame:
    """What a mailbox's texts are made of and no more, with a hash of it."""
    string = lambda c, n: c[n].cast("string").alias(n)
    people = lambda r: F.transform(r, lambda a: F.struct(string(a, "name"), string(a, "email"))).alias(r)
    files = F.transform("attachments", lambda a: F.struct(*[string(a, n) for n in ("filename", "content_type", "charset", "text")], a["content"].cast("binary").alias("content")))
    texts = ["subject", "message_id", "body", "text_html"] + ["annotation"] * labels
    held = [F.col("label_names").cast("array<string>").alias("label_names")] * labels
    out = _with_parts(messages).select(F.col("folder").cast("string").alias("folder"), "date", *[F.col(n).cast("string").alias(n) for n in texts], *map(people, ("from", "to", "cc", "bcc")), F.col("has_plain").cast("boolean").alias("has_plain"), *held, files.alias("attachments"))
    return out.withColumn("_h", F.xxhash64(*out.columns))


def _by_date(rows: DataFrame, rounds: int) -> list[DataFrame]:
    """Rows in ranges of dates, about even if no date has many; all rows are in one of them."""
    if rounds == 1:
        return [rows]
    at = F.unix_micros(F.col("date").cast("timestamp"))
    cuts = sorted(set(rows.agg(F.percentile_approx(at, [i / rounds for i in range(1, rounds)], 1000)).first()[0] or []))
    before = [F.coalesce(at < cut, F.lit(True)) for cut in cuts]  # no date comes first
    return [rows.where(hi & ~lo) for lo, hi in zip([F.lit(False), *before], [*before, F.lit(True)], strict=True)]


def write_mbox(messages: DataFrame, path: str, labels: bool = True, compression: str = "none") -> None:
    """A folder of mailbox text per mail folder: numbered files, each a range of dates, in order of date.

    A mail folder is cut by date, and messages of one moment by a hash, so a large one is
    the work of many tasks.  HTML and attachments are written as they are: a redacted copy must have them
    redacted or taken out before.

    Texts are several times as long as what they are made of, so rows are dealt and sorted, and
    texts are made last.  The rows are made once, written and removed at the end; many are
    sorted a range of dates after the other.  With a `compression` (gzip) files are packed;
    `read_mbox` takes them, each as a whole.
    """
    spark = messages.sparkSession
    place, rows = shared_folder(spark, "postbag-mail"), _mail_rows(messages, labels)
    try:
        with freeing_shuffles(spark):
            rows.write.option("compression", "zstd").parquet(place)
            held = size_of(spark, place)
            parts = _by_date(spark.read.schema(rows.schema).parquet(place), min(ROUNDS, 1 + held // ROUND_BYTES))
            n = max(spark.sparkContext.defaultParallelism, held // FILE_BYTES // len(parts))
            if len(parts) > 1:
                remove(spark, path)
            for k, part in enumerate(parts):
                cut = part.repartitionByRange(n, "folder", "date", "_h").sortWithinPartitions("folder", "date", "_h")
                texts = cut.withColumn("_mark", _mark()).withColumn("_content", _content(F.col("_mark"))).select("folder", mbox_text(labels, F.col("_content")).alias("text"))
                to = path if len(parts) == 1 else f"{path}/_round"
                texts.write.mode("overwrite").partitionBy("folder").option("compression", compression).text(to)
                if to != path:
                    move_parts(spark, to, path, k * n)
                    remove(spark, to)
    finally:
        remove(spark, place)


def with_duplicates(messages: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Messages plus one more copy for each recorded duplicate, in its own folder."""
    again = duplicates.select(F.col("kept_doc_id").alias("doc_id"), F.col("folder").alias("_f")).join(messages, "doc_id").withColumn("folder", F.col("_f")).drop("_f")
    return messages.unionByName(again.select(messages.columns))


def result_csv(messages: DataFrame) -> DataFrame:
    """Rows of a search result's CSV: eleven columns, named as the mailbox headers they stand for."""
    line = lambda n: F.coalesce(address_line(F.col(n)), F.lit("")).alias(f"{n.capitalize()}:")
    text = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    return messages.select(
        text(F.date_format("date", "EEE MMM dd HH:mm:ss yyyy"), "From -"),
        text(F.date_format("date", "yyyy-MM-dd HH:mm:ss"), "Date:"),
        *[line(n) for n in ("from", "to", "cc", "bcc")],
        text(F.col("subject"), "Subject:"),
        text(F.col("message_id"), "Message-ID:"),
        text(F.col("folder"), "X-Archive-Folder:"),
        text(F.col("annotation"), "X-Archive-Annotation:"),
        text(F.array_join("label_names", ";"), "X-Archive-Labels:"),
    )


def header_rows(messages: DataFrame, book: DataFrame, separator: str = ";") -> DataFrame:
    """A row per message: date, addresses and best names (book: email, best_name) of each
    role joined by the separator, subject.  The separator inside a value becomes `_`; an
    address without a name has its own text there."""
    roles = ("from", "to", "cc", "bcc")
    part = lambda r: F.transform(r, lambda a, i: F.struct(F.lit(r).alias("role"), i.alias("i"), F.lower(a["email"]).alias("email")))
    flat = messages.select("doc_id", F.explode(F.concat(*map(part, roles))).alias("x")).select("doc_id", "x.*")
    named = flat.join(book.select(F.lower("email").alias("email"), "best_name").dropDuplicates(["email"]), "email", "left").withColumn("best_name", F.coalesce("best_name", "email"))
    clean = lambda c: F.replace(c, F.lit(separator), F.lit("_"))
    joined = lambda r, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("i", clean(F.col(c)).alias("v"))))), lambda x: x["v"]), separator)
    per = named.groupBy("doc_id").agg(*[joined(r, c).alias(f"{r}_{n}") for r in roles for c, n in (("email", "ids"), ("best_name", "names"))])
    cells = [F.coalesce(f"{r}_{n}", F.lit("")).alias(f"{r}_{n}") for r in roles for n in ("ids", "names")]
    return messages.select("doc_id", "date", "subject").join(per, "doc_id", "left").select("doc_id", F.date_format("date", "yyyy-MM-dd").alias("date"), *cells, F.coalesce("subject", F.lit("")).alias("subject"))


def eml(messages: DataFrame) -> DataFrame:
    """(name, content) of one EML file per message: mailbox text without its first line and quoting."""
    body = F.regexp_replace(F.regexp_replace(mbox_text(False), r"^From [^\n]*\n", ""), r"(?m)^>(>*From )", "$1")
    return _with_parts(messages).select(F.concat(F.col("doc_id").cast("string"), F.lit(".eml")).alias("name"), F.replace(body, F.lit("\n"), F.lit("\r\n")).alias("content"))


def text_dump(messages: DataFrame, mentions: DataFrame) -> DataFrame:
    """(name, content) of two files per message: subject and body, and its names, lower-cased with _ for spaces."""
    full = messages.select(F.concat(F.col("doc_id").cast("string"), F.lit(".full")).alias("name"), F.concat(F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("content"))
    said = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.replace(F.lower("text"), F.lit(" "), F.lit("_")))).alias("names"))
    names = messages.select("doc_id").join(said, "doc_id", "left").select(F.concat(F.col("doc_id").cast("string"), F.lit(".names")).alias("name"), F.concat(F.coalesce(F.array_join("names", " "), F.lit("")), F.lit("\n")).alias("content"))
    return full.unionByName(names)


def copy_archive(tables: dict[str, DataFrame], path: str, keep: Column | None = None, without: tuple[str, ...] = ()) -> list[str]:
    """Write an archive's tables anew: only messages that `keep` holds for and what hangs
    on them, without some columns.  Returns the tables' names."""
    messages = tables["messages"] if keep is None else tables["messages"].where(keep)
    for name, df in tables.items():
        out = messages if name == "messages" else df if keep is None or "doc_id" not in df.columns else df.join(messages.select("doc_id"), "doc_id", "left_semi")
        out.drop(*without).write.mode("overwrite").parquet(f"{path}/{name}")
    return list(tables)


def authorities_csv(df: DataFrame) -> DataFrame:
    """Null and `?` cells read `unknown`."""
    return df.select(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == "?"), F.lit("unknown")).otherwise(F.col(c).cast("string")).alias(c) for c in df.columns])


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def manifest(files: DataFrame) -> DataFrame:
    """Checksums of a bag from (path, content) rows."""
    return files.select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("size"))


def verify(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files that are missing, added or changed against a manifest."""
    now = manifest(files).select("path", F.col("sha256").alias("now"))
    j = listed.select("path", "sha256").join(now, "path", "full_outer")
    return j.select("path", F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "added").when(F.col("now") != F.col("sha256"), "changed").alias("state")).where("state is not null")


def side_text(names: Column, emails: Column) -> Column:
    """An address-book record as text."""
    return F.concat(F.lit("--\n"), F.concat_ws("\n", names, emails), F.lit("\n"))


def event(kind: str, detail: str, outcome: str = "success") -> Column:
    """A preservation event as a row to append."""
    return F.struct(F.lit(kind).alias("type"), F.lit(detail).alias("detail"), F.lit(outcome).alias("outcome"), F.current_timestamp().alias("at"))
