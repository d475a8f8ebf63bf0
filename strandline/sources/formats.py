"""Text formats as DataFrames. Line formats are column expressions over `spark.read.text`; record formats parse whole
records in Arrow batches; writers produce text rows."""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.moltype import let
from ..functions.sequence import running
from ..session import ship

SEQ = "name string, ord int, seq string"


# reading files whole, for formats whose records span lines
def read_whole(spark: SparkSession, path: str, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """Each file's text through a parser; gz, bz2 and xz by suffix. A file is one task's work: for alignments and trees."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = {"gz": gzip.decompress, "bz2": bz2.decompress, "xz": lzma.decompress}
        for f in frames:
            for p, data in zip(f["path"], f["content"]):
                text = open_.get(p.rsplit(".", 1)[-1], bytes)(data).decode("utf-8", "replace")
                yield pd.DataFrame([(p.rsplit("/", 1)[-1], *r) for r in parse(text)], columns=["file", *names])

    return files.mapInPandas(run, "file string, " + schema)


# FASTA: records split by Spark itself, so a large file is read by many tasks
def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, label, seq): records begin with >; white space in sequences goes, letters are upper case."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("r")).filter("trim(r) <> ''")
    label = F.trim(F.split("r", "\r?\n", 2)[0])
    seq = F.upper(F.regexp_replace(F.coalesce(F.try_element_at(F.split("r", "\r?\n", 2), F.lit(2)), F.lit("")), r"\s+", ""))
    return raw.select(F.split(label, r"\s+")[0].alias("name"), label.alias("label"), seq.alias("seq"))


def parse_label(label: Column, fields: Sequence[str], split: str = "|") -> Column:
    """A label's parts as a struct."""
    parts = F.split(label, re.escape(split))
    return F.struct(*[F.try_element_at(parts, F.lit(i + 1)).alias(f) for i, f in enumerate(fields)])


def parse_fasta(text: str) -> list[tuple]:
    out = []
    for i, rec in enumerate(r for r in re.split(r"(?m)^>", text) if r.strip()):
        head, _, body = rec.partition("\n")
        out.append((head.strip(), i, re.sub(r"\s+", "", body).upper()))
    return out


def parse_gde(text: str) -> list[tuple]:
    return parse_fasta(re.sub(r"(?m)^[%#]", ">", text))


def parse_phylip(text: str) -> list[tuple]:
    """Sequential or interleaved, by whether the second line's sequence is whole."""
    lines = [x for x in text.splitlines() if x.strip()]
    n, length = map(int, lines[0].split()[:2])
    body = lines[1:]
    names, parts = [], []
    if len(body) >= n and len(body) % n == 0 and not all(len("".join(x.split()[1:])) >= length for x in body[:n]):
        for i, line in enumerate(body):
            if i < n:
                name, _, rest = line.strip().partition(" ")
                names.append(name)
                parts.append(rest)
            else:
                parts[i % n] += line
        seqs = [re.sub(r"\s+", "", p) for p in parts]
        if all(len(s) == length for s in seqs):
            return [(a, i, s.upper()) for i, (a, s) in enumerate(zip(names, seqs))]
    out, now, held = [], None, ""
    for line in body:
        if now is None:
            now, _, held = line.strip().partition(" ")
            held = re.sub(r"\s+", "", held)
        else:
            held += re.sub(r"\s+", "", line)
        if len(held) >= length:
            out.append((now, len(out), held.upper()))
            now = None
    return out


def parse_paml(text: str) -> list[tuple]:
    """A header of counts, then names and sequences on lines of their own."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    length = int(lines[0].split()[1])
    out, name, held = [], None, ""
    for line in lines[1:]:
        if name is None:
            name = line
        else:
            held += re.sub(r"\s+", "", line)
            if len(held) >= length:
                out.append((name, len(out), held.upper()))
                name, held = None, ""
    return out


def parse_clustal(text: str) -> list[tuple]:
    seqs: dict[str, str] = {}
    for line in text.splitlines()[1:]:
        m = re.match(r"^(\S+)\s+([A-Za-z\-?*.]+)(\s+\d+)?\s*$", line)
        if m:
            seqs[m[1]] = seqs.get(m[1], "") + m[2].upper()
    return [(n, i, s) for i, (n, s) in enumerate(seqs.items())]


def parse_msf(text: str) -> list[tuple]:
    seqs: dict[str, str] = {m: "" for m in re.findall(r"(?m)^\s*Name:\s+(\S+)", text)}
    for line in text.partition("//")[2].splitlines():
        name, *rest = line.split() or [""]
        if name in seqs:
            seqs[name] += "".join(rest).replace(".", "-").replace("~", "-").upper()
    return [(n, i, s) for i, (n, s) in enumerate(seqs.items())]


def parse_nexus(text: str) -> list[tuple]:
    body = re.search(r"(?is)\bmatrix\b(.*?);", text)
    seqs: dict[str, str] = {}
    for line in (body[1] if body else "").splitlines():
        line = re.sub(r"\[[^\]]*\]", "", line).strip()
        if line:
            m = re.match(r"('[^']*'|\S+)\s+(.*)", line)
            if m:
                n = m[1].strip("'")
                seqs[n] = seqs.get(n, "") + re.sub(r"\s+", "", m[2]).upper()
    return [(n, i, s) for i, (n, s) in enumerate(seqs.items())]


def parse_nexus_trees(text: str) -> list[tuple]:
    """(tree_id, newick) with the translate table applied."""
    block = re.search(r"(?is)begin\s+trees\s*;(.*?)end\s*;", text)
    body = block[1] if block else ""
    table = dict(x.split(None, 1) for x in re.sub(r"\s+", " ", t[1]).strip().split(",") if x.strip()) if (t := re.search(r"(?is)translate(.*?);", body)) else {}
    table = {k.strip(): v.strip() for k, v in table.items()}
    out = []
    for name, tree in re.findall(r"(?im)^\s*u?tree\s+\*?\s*([^=\s]+)\s*=\s*(?:\[[^\]]*\]\s*)?([^;]+;)", body):
        out.append((name.strip("'\""), re.sub(r"(?<=[(,])\s*([^():,;\s]+)", lambda m: table.get(m[1], m[1]), tree).strip()))
    return out


def parse_dialign(text: str) -> list[tuple]:
    seqs: dict[str, str] = {}
    for line in text.splitlines():
        m = re.match(r"^(\S+)\s+\d+\s+([A-Za-z\- ]+)$", line)
        if m:
            seqs[m[1]] = seqs.get(m[1], "") + m[2].replace(" ", "")
    return [(n, i, s.upper()) for i, (n, s) in enumerate(seqs.items())]


def parse_genbank(text: str) -> list[tuple]:
    """(locus, definition, organism, seq, features as JSON: type, location, spans, strand, qualifiers)."""
    out = []
    for rec in re.split(r"(?m)^//\s*$", text):
        if not rec.strip():
            continue
        field = lambda k: " ".join(m[1].split()) if (m := re.search(rf"(?ms)^{k}\s+(.*?)(?=^\S)", rec)) else ""
        organism = m[1].strip() if (m := re.search(r"(?m)^\s+ORGANISM\s+(.*)$", rec)) else ""
        seq = re.sub(r"[^A-Za-z]", "", m[1]).upper() if (m := re.search(r"(?ms)^ORIGIN[^\n]*\n(.*)", rec)) else ""
        feats = []
        table = m[1] if (m := re.search(r"(?ms)^FEATURES[^\n]*\n(.*?)(?=^\S)", rec)) else ""
        for f in re.split(r"(?m)^ {5}(?=\S)", table):
            if not f.strip():
                continue
            kind, _, rest = f.partition(" ")
            place, *quals = re.split(r"(?m)^\s+/", rest)
            place = re.sub(r"\s+", "", place)
            spans, strand = location(place)
            q: dict[str, list[str]] = {}
            for x in quals:
                k, _, v = x.partition("=")
                q.setdefault(k.strip(), []).append(re.sub(r"\s*\n\s+", "" if k.strip() == "translation" else " ", v.strip()).strip('"'))
            feats.append({"type": kind, "location": place, "spans": spans, "strand": strand, "qualifiers": q})
        out.append((field("LOCUS").split(" ")[0], field("DEFINITION"), organism, seq, json.dumps(feats)))
    return out


GENBANK = "locus string, definition string, organism string, seq string, features string"


def location(text: str) -> tuple[list[list[int]], int]:
    """Spans, half open from 0, and strand of a feature location with join, order and complement."""
    strand = -1 if text.startswith("complement") or ("complement" in text and "join(complement" in text) else 1
    spans = [[int(a) - 1, int(b or a)] for a, b in re.findall(r"<?(\d+)(?:\.\.>?(\d+))?", re.sub(r"\w+(\.\d+)?:", "", text))]
    return sorted(spans), strand


def genbank_features(records: DataFrame) -> DataFrame:
    """The store's columns from parsed records."""
    kind = "array<struct<type:string,location:string,spans:array<array<bigint>>,strand:int,qualifiers:map<string,array<string>>>>"
    f = records.select("locus", F.explode(F.from_json("features", kind)).alias("f"))
    spans = F.transform("f.spans", lambda s: F.struct(s[0].alias("start"), s[1].alias("stop")))
    q = F.col("f.qualifiers")
    name = F.coalesce(F.try_element_at(q, F.lit("gene"))[0], F.try_element_at(q, F.lit("locus_tag"))[0], F.try_element_at(q, F.lit("product"))[0], F.col("f.type"))
    return f.select(F.col("locus").alias("seqid"), F.lit("genbank").alias("source"), F.col("f.type").alias("biotype"), name.alias("name"), spans.alias("spans"), F.col("f.strand").alias("strand"), F.to_json(q).alias("attributes"))


def parse_embl(text: str) -> list[tuple]:
    """(id, accession, description, organism, seq) of EMBL or SwissProt records."""
    out = []
    for rec in re.split(r"(?m)^//\s*$", text):
        if not rec.strip():
            continue
        line = lambda k: " ".join(x.strip() for x in re.findall(rf"(?m)^{k}   (.*)$", rec))
        seq = re.sub(r"[^A-Za-z]", "", m[1]).upper() if (m := re.search(r"(?ms)^SQ[^\n]*\n(.*)", rec)) else ""
        out.append((line("ID").split(" ")[0].rstrip(";"), line("AC").split(";")[0], line("DE"), line("OS"), seq))
    return out


EMBL = "id string, accession string, description string, organism string, seq string"


def key_value_records(text: str, start: str | None = None, end: str | None = None, sep: str = "=") -> list[dict[str, str]]:
    """Records of key-value lines, between marks or blank lines."""
    out: list[dict[str, str]] = [{}]
    for line in text.splitlines():
        x = line.strip()
        if not x or x in (start, end):
            if out[-1]:
                out.append({})
        elif sep in x:
            k, _, v = x.partition(sep)
            out[-1][k.strip()] = v.strip()
    return [r for r in out if r]


def parse_locuslink(text: str) -> list[tuple]:
    """(id, record as JSON) of `>>id` records with `KEY: value` lines, repeated keys listed."""
    out = []
    for rec in re.split(r"(?m)^>>", text)[1:]:
        head, _, body = rec.partition("\n")
        fields: dict[str, list[str]] = {}
        for line in body.splitlines():
            k, s, v = line.partition(":")
            if s:
                fields.setdefault(k.strip(), []).append(v.strip())
        out.append((head.strip(), json.dumps(fields)))
    return out


def parse_unigene(text: str) -> list[tuple]:
    out = []
    for rec in re.split(r"(?m)^//\s*$", text):
        fields: dict[str, list[str]] = {}
        for line in rec.splitlines():
            k, _, v = line.partition(" ")
            if k and v.strip():
                fields.setdefault(k, []).append(v.strip())
        if fields:
            out.append((fields.get("ID", [""])[0], json.dumps(fields)))
    return out


def parse_rdb(text: str) -> list[tuple]:
    """(name, ord, seq) of records whose header lines hold `key:` fields and end with a blank or `-` line, `seq:` last."""
    out = []
    for rec in re.split(r"(?m)^//\s*$", text):
        name = m[1].strip() if (m := re.search(r"(?m)^seq:\s*(.*)$", rec)) else None
        if name:
            body = rec.split("\n", rec[: m.end()].count("\n") + 1)[-1]
            out.append((name, len(out), re.sub(r"[\s*]", "", body).upper()))
    return out


ALIGNED: dict[str, Callable[[str], list[tuple]]] = {
    "fasta": parse_fasta, "fa": parse_fasta, "mfa": parse_fasta, "gde": parse_gde, "phylip": parse_phylip, "phy": parse_phylip, "paml": parse_paml,
    "aln": parse_clustal, "clustal": parse_clustal, "msf": parse_msf, "nex": parse_nexus, "nexus": parse_nexus, "nxs": parse_nexus, "dialign": parse_dialign, "rdb": parse_rdb,
}


def get_parser(format_name: str | None, path: str) -> Callable[[str], list[tuple]]:
    key = format_name or re.sub(r"\.(gz|bz2|xz)$", "", path).rsplit(".", 1)[-1]
    if key not in ALIGNED:
        raise ValueError(f"no parser for {key}")
    return ALIGNED[key]


def load_seqs(spark: SparkSession, path: str, format_name: str | None = None) -> DataFrame:
    """(file, name, ord, seq) of one file, or of all that a glob matches, by format or suffix."""
    return read_whole(spark, path, get_parser(format_name, path), SEQ)


# line formats
def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_gff(spark.read.text(path))


def parse_gff(lines: DataFrame) -> DataFrame:
    """GFF2 and GFF3 lines (value) as (seqid, source, biotype, start, stop, score, strand, phase, attributes, id, parent_id):
    0-based half open, negative and swapped ends put right; comments after # go."""
    text = F.regexp_replace("value", "#.*$", "")
    p = F.split(text, "\t")
    rows = lines.filter(F.trim(text) != "").select(p.alias("p")).filter(F.size("p") >= 8)
    a, b = F.abs(F.trim(F.col("p")[3]).cast("long") - 1), F.abs(F.trim(F.col("p")[4]).cast("long"))
    attributes = F.trim(F.coalesce(F.try_element_at("p", F.lit(9)), F.lit("")))
    gff3 = lambda k: F.nullif(F.regexp_extract(attributes, rf"(?:^|;)\s*{k}=([^;]*)", 1), F.lit(""))
    gff2 = F.nullif(F.regexp_extract(attributes, r'"([^"]*)"', 1), F.lit(""))
    return rows.select(
        F.trim(F.col("p")[0]).alias("seqid"), F.col("p")[1].alias("source"), F.col("p")[2].alias("biotype"), F.least(a, b).alias("start"), F.greatest(a, b).alias("stop"),
        F.col("p")[5].alias("score"), F.col("p")[6].alias("strand"), F.col("p")[7].alias("phase"), attributes.alias("attributes"), F.coalesce(gff3("ID"), gff2).alias("id"), gff3("Parent").alias("parent_id"),
    )


def merged_gff(rows: DataFrame) -> DataFrame:
    """Lines of one ID as one feature with all spans; lines without ID stand alone."""
    key = F.coalesce("id", F.concat_ws(":", F.lit("unknown"), "seqid", "biotype", "start", "stop", "strand"))
    g = rows.withColumn("name", key).groupBy("seqid", "name")
    first = [F.min_by(c, "start").alias(c) for c in ("source", "biotype", "strand", "attributes", "parent_id")]
    return g.agg(*first, F.min("start").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))


PSL = "matches mismatches repmatches ncount qnuminsert qbaseinsert tnuminsert tbaseinsert strand qname qsize qstart qend tname tsize tstart tend blockcount blocksizes qstarts tstarts".split()


def parse_psl(lines: DataFrame) -> DataFrame:
    """BLAT rows: 21 fields, headers skipped; the last three as arrays."""
    p = F.split("value", "\t")
    rows = lines.filter(F.col("value").rlike(r"^\d+\t")).select(p.alias("p"))
    text = {"strand", "qname", "tname"}
    lists = {"blocksizes", "qstarts", "tstarts"}

    def one(i: int, n: str) -> Column:
        c = F.col("p")[i]
        if n in lists:
            return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int")).alias(n)
        return (c if n in text else c.cast("int")).alias(n)

    return rows.select(*[one(i, n) for i, n in enumerate(PSL)])


BLAST9 = "query subject identity length mismatches gap_openings q_start q_end s_start s_end e_value bit_score".split()


def parse_blast9(lines: DataFrame) -> DataFrame:
    """Tabular BLAST rows, comments skipped, bad rows dropped."""
    p = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#")).select(p.alias("p")).filter(F.size("p") >= 12)
    text = {"query", "subject"}
    out = rows.select(*[(F.col("p")[i] if n in text else F.expr(f"try_cast(p[{i}] AS double)")).alias(n) for i, n in enumerate(BLAST9)])
    return out.filter("e_value IS NOT NULL")


def best_hits(hits: DataFrame, n: int = 1, by: str = "query", field: str = "e_value", subject: str = "subject", keep_self: bool = True) -> DataFrame:
    """The n best hits of each query, ties by subject."""
    from pyspark.sql import Window as W

    rows = hits if keep_self else hits.filter(F.col(by) != F.col(subject))
    w = W.partitionBy(by).orderBy(field, subject)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def parse_jaspar(text: str) -> list[tuple]:
    """(pos, motif, n) of a count matrix with rows `A [ 1 2 3 ]`."""
    out = []
    for line in text.splitlines():
        m = re.match(r"^\s*([ACGTU])\s*\[?([\d.\s]+)\]?\s*$", line)
        if m:
            out += [(i, m[1], float(v)) for i, v in enumerate(m[2].split())]
    return sorted(out)


def parse_cisbp(text: str) -> list[tuple]:
    """(pos, motif, p) of a tab table with a header `Pos A C G T`."""
    head, *rows = [x.split("\t") for x in text.splitlines() if x.strip()]
    return [(int(r[0]) - 1, h.strip(), float(v)) for r in rows for h, v in zip(head[1:], r[1:])]


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """GBSeq, TinySeq and BLAST XML by their row tags, through Spark's reader."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def ncbi_taxonomy(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """(taxid, parent, rank, name) from the dump files, scientific names only."""
    cut = lambda p: spark.read.text(p).select(F.split("value", r"\t\|\t?").alias("p"))
    a = cut(nodes).select(F.col("p")[0].cast("long").alias("taxid"), F.col("p")[1].cast("long").alias("parent"), F.col("p")[2].alias("rank"))
    b = cut(names).filter(F.col("p")[3] == "scientific name").select(F.col("p")[0].cast("long").alias("taxid"), F.col("p")[1].alias("name"))
    return a.join(b, "taxid", "left")


# CIGAR
def cigar_gaps(cigar: Column) -> Column:
    """array<struct<pos, length>> of D runs, pos in the ungapped sequence; M counts letters. Insertions are refused."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d*[MDI])"), F.lit(1)), lambda o: F.struct(F.coalesce(F.nullif(F.regexp_extract(o, r"^\d*", 0), F.lit("")).cast("int"), F.lit(1)).alias("n"), F.right(o, F.lit(1)).alias("op")))
    kind = "array<struct<pos:int,length:int>>"

    def spans(o: Column) -> Column:
        at = running(F.transform(o, lambda x: F.when(x["op"] == "D", 0).otherwise(x["n"])))
        return F.array_compact(F.zip_with(o, at, lambda x, n: F.when(x["op"] == "D", F.struct(n.alias("pos"), x["n"].alias("length")))))

    refused = F.raise_error(F.lit("insertions aren't supported")).cast(kind)
    return F.when(F.contains(cigar, F.lit("I")), refused).otherwise(let(ops, spans))


def to_cigar(seq: Column) -> Column:
    """M and D runs of a gapped sequence."""
    runs = F.regexp_extract_all(seq, F.lit(r"(-+|[^-]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.when(F.length(r) > 1, F.length(r).cast("string")).otherwise(F.lit("")), F.when(r.startswith("-"), "D").otherwise("M"))), "")


def slice_cigar(seq: Column, cigar: Column, start: Column, stop: Column, by_align: bool = True) -> Column:
    """The gapped row of an ungapped sequence and its CIGAR text, from `start` to `stop` of the alignment, or of the
    sequence itself: then up to the last of these letters, gaps before the first one left out."""
    from ..functions.sequence import align_index, compose_gapped

    row = compose_gapped(seq, cigar_gaps(cigar))
    if by_align:
        return F.substring(row, start + 1, stop - start)
    return let(row, lambda r: F.substring(r, align_index(r, start) + 1, align_index(r, stop - 1) + 1 - align_index(r, start)))


def cigar_alignment(seqs: DataFrame, cigars: DataFrame) -> DataFrame:
    """Aligned rows from ungapped sequences (name, ord, seq) and their CIGAR texts (name, cigar)."""
    from ..functions.sequence import compose_gapped

    rows = seqs.join(cigars.select("name", "cigar"), "name")
    return rows.select("name", "ord", compose_gapped("seq", cigar_gaps(F.col("cigar"))).alias("seq"))


def parse_greengenes(text: str) -> list[tuple]:
    """(id, record as JSON) of records between BEGIN and END, lines `key=value`."""
    return [(r.get("prokMSA_id", ""), json.dumps(r)) for r in key_value_records(text, "BEGIN", "END")]


def get_writer(format_name: str | None, path: str = "") -> Callable[[DataFrame], str]:
    """The text writer of a format, by name or by a path's suffix."""
    key = format_name or re.sub(r"\.(gz|bz2|xz)$", "", path).rsplit(".", 1)[-1]
    key = {"fa": "fasta", "mfa": "fasta", "phy": "phylip", "aln": "clustal", "nex": "nexus", "nxs": "nexus"}.get(key, key)
    if key not in WRITERS:
        raise ValueError(f"no writer for {key}")
    return WRITERS[key]


# delimited
def load_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, title: bool = False, legend: bool = False, limit: int | None = None) -> DataFrame:
    """A delimited file, columns as strings; a title line before it and a legend line after it are left out."""
    if not (title or legend):
        df = spark.read.option("header", header).option("sep", sep).csv(path)
        return df.limit(limit) if limit is not None else df

    def parse(text: str) -> list[tuple]:
        lines = text.splitlines()[1 if title else 0 : -1 if legend else None]
        return [("\n".join(lines),)]

    import csv

    body = read_whole(spark, path, parse, "text string").select("text").collect()
    rows = [r for b in body for r in csv.reader(b[0].splitlines(), delimiter=sep)]
    head = rows.pop(0) if header and rows else [f"_c{i}" for i in range(len(rows[0]) if rows else 0)]
    df = spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{h}` string" for h in head))
    return df.limit(limit) if limit is not None else df


# writers: text of a (small) alignment
def _ordered(seqs: DataFrame) -> list[tuple[str, str]]:
    return [(r[0], r[1]) for r in seqs.orderBy("ord", "name").select("name", "seq").collect()]


def write_fasta(seqs: DataFrame, path: str, block: int = 60) -> None:
    """By Spark, part files of whole records."""
    from ..functions.sequence import to_fasta

    seqs.select(to_fasta("name", "seq", block).alias("value")).write.mode("overwrite").text(path)


def fasta_text(seqs: DataFrame, block: int = 60) -> str:
    return "".join(f">{n}\n" + "".join(s[i : i + block] + "\n" for i in range(0, len(s), block)) for n, s in _ordered(seqs))


def phylip_text(seqs: DataFrame, block: int = 60) -> str:
    rows = _ordered(seqs)
    return f"{len(rows)}  {len(rows[0][1]) if rows else 0}\n" + "".join(f"{n:<10}" + "".join((" " * 10 if i else "") + s[i : i + block] + "\n" for i in range(0, len(s), block)) for n, s in rows)


def paml_text(seqs: DataFrame, block: int = 60) -> str:
    rows = _ordered(seqs)
    return f"{len(rows)}  {len(rows[0][1]) if rows else 0}\n" + "".join(f"{n}\n" + "".join(s[i : i + block] + "\n" for i in range(0, len(s), block)) for n, s in rows)


def gde_text(seqs: DataFrame, block: int = 60) -> str:
    return fasta_text(seqs, block).replace(">", "%")


def clustal_text(seqs: DataFrame, wrap: int = 60) -> str:
    rows = _ordered(seqs)
    wide = max((len(n) for n, _ in rows), default=0)
    parts = [f"{n:<{wide}}    {s[i : i + wrap]}\n" if j else ("\n" if i else "") + f"{n:<{wide}}    {s[i : i + wrap]}\n" for i in range(0, len(rows[0][1]) if rows else 0, wrap) for j, (n, s) in enumerate(rows)]
    return "CLUSTAL\n\n" + "".join(parts)


def nexus_text(seqs: DataFrame, seq_type: str = "dna", wrap: int = 50) -> str:
    rows = _ordered(seqs)
    wide = max((len(n) for n, _ in rows), default=0)
    length = len(rows[0][1]) if rows else 0
    body = "\n".join(f"{n:<{wide}}    {s[i : i + wrap]}" for i in range(0, length, wrap) for n, s in rows)
    return f"#NEXUS\n\nbegin data;\n    dimensions ntax={len(rows)} nchar={length};\n    format datatype={seq_type} interleave=yes missing=? gap=-;\n    matrix\n{body}\n    ;\nend;\n"


WRITERS = {"fasta": fasta_text, "phylip": phylip_text, "paml": paml_text, "gde": gde_text, "clustal": clustal_text, "nexus": nexus_text}


def bedgraph(df: DataFrame, digits: int = 2, name: str = "track", by: Sequence[str] = ("chrom",)) -> DataFrame:
    """Text rows of (chrom, start, stop, value): neighbours of one rounded value merged, a track line first."""
    from ..operators.intervals import merge_by_value

    merged = merge_by_value(df.withColumn("value", F.round("value", digits)), "value", by)
    line = F.concat_ws("\t", *by, "start", "stop", F.format_string(f"%.{digits}f", F.col("value").cast("double")))
    rows = merged.select(F.lit(1).alias("k"), *by, "start", line.alias("value"))
    top = df.sparkSession.range(1).select(F.lit(0).alias("k"), *[F.lit(None).cast(dict(df.dtypes)[b]).alias(b) for b in by], F.lit(None).cast("long").alias("start"), F.lit(f'track type=bedGraph name="{name}"').alias("value"))
    return top.unionByName(rows).orderBy("k", *by, "start").select("value")
