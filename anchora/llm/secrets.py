"""Secret scans in native column functions: base patterns, and character Markov models of random and ordinary strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: What the Markov models judge: long runs of identifier characters.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: What they judge in a run that is ordinary as a whole: its long parts between separators.
PART = r"[A-Za-z0-9+]{16,}"
#: Characters that the models know, at their index; all others share one more index.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = len(ALPHABET) + 1
#: Strings are compared with strings of like characters, by a pair of models for each of: both cases, upper case, lower case,
#: and neither but for a to f.
CLASSES = "case when {0} rlike '[A-Z]' then case when {0} rlike '[a-z]' then 0 else 1 end when {0} rlike '[g-z]' then 2 else 3 end"
N_CLASSES = 4
#: Added to each count of a transition, so that one never seen is unlikely but possible.
ADDED = 0.1
KINDS = ("assign", "access", "hex", "markov")
#: Matches that are laid out together.
BLOCK = 64


def _let(value: Column, body) -> Column:
    """``body`` of a column that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _blocks(rows: Column) -> Column:
    """An array cut into arrays of at most BLOCK."""
    last = F.greatest(F.ceil(F.size(rows) / BLOCK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)))


def _flat(parts: Column, kind: str, shifted, advance) -> Column:
    """The ``out`` arrays of ``parts`` (at, out) as one array: ``shifted(item, at)`` lays an item out after all parts before
    it, which reach to ``at``; ``advance(at, part's at)`` tells how far they reach with one more."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    step = lambda acc, x: F.struct(advance(acc["at"], x["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(x["out"], lambda item: shifted(item, acc["at"])))).alias("out"))
    return F.flatten(F.aggregate(parts, zero, step)["out"])


def _moved(span: Column, by: Column) -> Column:
    return F.struct((span["start"] + by).alias("start"), span["rank"].alias("rank"), span["kind"].alias("kind"), (span["end"] + by).alias("end"), span["value"].alias("value"))


def _after(piece: Column, at: Column) -> Column:
    return F.struct(F.greatest(piece["start"], at).alias("start"), F.greatest(piece["end"], at).alias("end"), (piece["joined"] | (piece["start"] < at)).alias("joined"))


_SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"
_PIECE = "struct<start:int,end:int,joined:boolean>"


def spans_of(text: Column, pattern: str, kind: str, accept=None) -> Column:
    """Array of (start, rank, kind, end, value) for the leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves give the places by running sums of lengths: within blocks of
    matches first, then over the blocks, so that work grows with the matches and not with their square."""
    pieces, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if accept is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    rows = F.transform(F.arrays_zip(pieces.alias("piece"), found.alias("m"), value.alias("v")), lambda x: F.struct(x["piece"].alias("piece"), F.coalesce(x["m"], F.lit("")).alias("m"), x["v"].alias("v")))
    parts = _let(rows, lambda r: F.transform(_blocks(r), lambda b: F.aggregate(b, zero, step)))
    spans = F.filter(_flat(parts, _SPAN, _moved, lambda at, more: at + more), lambda s: s["value"].isNotNull())
    if accept is not None:
        spans = F.filter(spans, lambda s: accept(s["value"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def disjoint(spans: Column) -> Column:
    """Array of (start, end, joined) that covers what ``spans`` (ordered by start) cover, none over another; ``joined``:
    it goes on where an earlier span that overlaps it ends."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PIECE}>").alias("out"))

    def step(acc, s):
        piece = _after(F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(False).alias("joined")), acc["at"])
        return F.struct(piece["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    parts = F.transform(_blocks(spans), lambda b: F.aggregate(b, zero, step))
    return F.filter(_flat(parts, _PIECE, _after, F.greatest), lambda p: p["start"] < p["end"])


def replaced(text: Column, spans: Column, mask) -> Column:
    """``text`` with ``mask(piece)`` in place of each disjoint piece of ``spans`` (ordered by start).

    The text is cut into stretches of BLOCK pieces first, so no piece is looked for from the text's start."""

    def stretch(pieces, b):
        block = F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))
        begin = F.when(b == 0, F.lit(0)).otherwise(F.get(pieces, b * BLOCK - 1)["end"])
        here = F.struct(block.alias("block"), begin.alias("begin"), F.element_at(block, -1)["end"].alias("end"))

        def cut(x):
            inside = text.substr(x["begin"] + 1, x["end"] - x["begin"])

            def joined(y):
                before = lambda p, i: F.when(i == 0, x["begin"]).otherwise(F.get(x["block"], i - 1)["end"])
                return F.array_join(F.transform(x["block"], lambda p, i: F.concat(y.substr(before(p, i) - x["begin"] + 1, p["start"] - before(p, i)), mask(p))), "")

            return _let(inside, joined)

        return _let(here, cut)

    def whole(pieces):
        n = F.ceil(F.size(pieces) / BLOCK).cast("int")
        tail = text.substr(F.element_at(pieces, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda b: stretch(pieces, b)), ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(_let(disjoint(spans), whole))


#: Words of ordinary identifiers, in several languages, so that a table of few words is judged like any other.
SAMPLE_WORDS = """
account address archive article backup balance browser builder calendar category channel client cluster column command comment config connection content context control counter country customer
database default delivery description device directory document download element encoder engine entity environment error event example export factory feature field filter folder format function
gateway generator graph group handler header history holiday identifier image import index information instance interface invoice iterator journal kernel language latitude layout library license
listener location manager matrix memory message method metric model module monitor network notification number object operation option order package page parameter parser partition payment pipeline
platform player plugin pointer policy position process product profile project property protocol provider queue record reference region register release report request resource response result
abfrage adresse anzeige aufgabe ausgabe benutzer bestellung datei drucker eingabe ergebnis fehler freigabe geschwindigkeit kennwort kunde lieferung nachricht rechnung schalter speicher sprache verbindung
adresse bibliotheque bouton chemin commande compte connexion courriel dossier echange fichier journee langue message monnaie navigateur numero paiement requete reseau resultat serveur utilisateur
archivo ayuda busqueda cuenta direccion entrega envio factura fecha idioma lectura mensaje nombre pagina pedido producto prueba respuesta servidor tarjeta trabajo usuario ventana
""".split()


def ordinary_words(docs: DataFrame) -> DataFrame:
    """(token, other) of SAMPLE_WORDS, each with several of the others, and of the distinct runs of 8 letters or more of all
    texts that are spelt like words: one case, or a capital first. Random strings hardly ever are, so no label is needed."""
    n = len(SAMPLE_WORDS)
    word = lambda k: F.get(F.array(*map(F.lit, SAMPLE_WORDS)), k.cast("int"))
    shipped = docs.sparkSession.range(12 * n).select(word(F.col("id") % n).alias("token"), word((F.col("id") * 7 + F.expr(f"id div {n}") * 31) % n).alias("other"))
    texts = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(texts, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Z]?[a-z]{7,}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    own = docs.select(F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return own.select("token", F.lower("token").alias("other")).union(shipped)


def labelled_samples(docs: DataFrame, n_random: int = 4000) -> DataFrame:
    """(token, label, held_out). Ordinary (0): SAMPLE_WORDS and the words of all documents, each alone and as one of the
    forms that identifiers made of words have (chosen by a hash), and numbers and UUIDs. Random (1): keys of ``n_random`` SHA-512 digests in the alphabets that keys come in. One
    token in five, by its hash, is held out of training."""
    spark = docs.sparkSession
    word, low, second = F.col("token"), F.lower("token"), F.col("other")
    number = F.pmod(F.xxhash64("token", "other"), F.lit(10_000))
    other = F.substring(F.reverse(second), 1, 6)
    forms = F.array(
        F.concat(F.lit("get_"), low, F.lit("_v"), (number % 9 + 1).cast("string")), F.concat(low, F.initcap(second), number.cast("string")),
        F.concat(F.lit("/"), low, F.lit("/"), second, F.lit("-"), number.cast("string")), F.concat(low, F.lit("-"), second, F.lit("_"), F.lit("2024-01-"), (number % 28 + 1).cast("string")), F.concat(F.upper("token"), F.lit("_"), F.upper(other)),
    )
    ordinary = ordinary_words(docs).select(F.explode(F.array(word, F.get(forms, (number % 5).cast("int")))).alias("token"))
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    plain = F.regexp_replace(base64, "[+/]", "")
    keys = F.array(
        F.substring(base64, 1, 40), F.substring(plain, 1, 32), F.substring(digest, 1, 40), F.substring(F.regexp_replace(F.upper(base64), "[^A-Z0-9]", ""), 1, 24),
        F.substring(F.regexp_replace(F.lower(base64), "[^a-z0-9]", ""), 1, 32), F.substring(F.regexp_replace(base64, "[^A-Za-z]", ""), 1, 32),
    )
    digits = F.substring(F.translate(digest, "abcdef", "012345"), 1, 18)
    uuid = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((65, 8), (73, 4), (77, 4), (81, 4), (85, 12))))
    ids = spark.range(n_random)
    plain_ids = ids.where(F.col("id") % 3 == 0).select(digits.alias("token")).union(ids.where(F.col("id") % 150 == 0).select(uuid.alias("token")))
    labelled = ordinary.unionByName(plain_ids).withColumn("label", F.lit(0)).unionByName(ids.select(F.explode(keys).alias("token"), F.lit(1).alias("label")))
    return labelled.withColumn("held_out", F.pmod(F.xxhash64("token", F.lit("held out")), F.lit(5)) == 0)


def rates(samples: DataFrame, table: list[float], threshold: float) -> DataFrame:
    """One row: tp, fp, fn, tn of the ratio at ``threshold`` over ``samples`` (token, label) of 16 characters or more."""
    judged = samples.where(F.length("token") >= 16).select("label", F.expr(f"{_ratio('token', _literal(table))} > {threshold:f}").alias("found"))
    n = lambda label, found: F.count_if((F.col("label") == label) & (F.col("found") == found))
    return judged.agg(n(1, True).alias("tp"), n(0, True).alias("fp"), n(1, False).alias("fn"), n(0, False).alias("tn"))


def _pairs(token: str) -> str:
    return f"transform(sequence(1, length({token}) - 1), i -> {_pair_index(token)})"


def _pair_index(token: str) -> str:
    """SQL for the index of the character pair at ``i``: row of the first, column of the second."""
    place = lambda c: f"(case when locate({c}, '{ALPHABET}') = 0 then {WIDTH} else locate({c}, '{ALPHABET}') end - 1)"
    return f"{place(f'substring({token}, i, 1)')} * {WIDTH} + {place(f'substring({token}, i + 1, 1)')}"


def _literal(table: list[float]) -> str:
    return "cast(split('" + ",".join(f"{x:.5f}" for x in table) + "', ',') as array<double>)"


def _ratio(token: str, table: str) -> str:
    """SQL for the mean log-likelihood ratio of a token's character pairs, by the models of its class."""
    own = f"slice({table}, ({CLASSES.format(token)}) * {WIDTH * WIDTH} + 1, {WIDTH * WIDTH})"
    return f"get(transform(array({own}), own -> aggregate({_pairs(token)}, cast(0 as double), (a, p) -> a + get(own, p))), 0) / greatest(length({token}) - 1, 1)"


def markov_table(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character transition, random over ordinary, with ADDED to each count, for each class
    of strings in turn.

    The table has N_CLASSES * WIDTH * WIDTH entries whatever the samples' size; only the counts of transitions come to the
    driver."""
    pairs = samples.where(F.length("token") >= 2).select("label", F.expr(CLASSES.format("token")).alias("like"), F.explode(F.expr(_pairs("token"))).alias("pair"))
    rows = pairs.groupBy("label", "like", "pair").agg(F.count("*").alias("n")).collect()
    counts = [[ADDED] * (N_CLASSES * WIDTH * WIDTH) for _ in range(2)]
    for r in rows:
        counts[r["label"]][r["like"] * WIDTH * WIDTH + r["pair"]] += r["n"]
    import math

    sums = [[sum(c[k * WIDTH : (k + 1) * WIDTH]) for k in range(N_CLASSES * WIDTH)] for c in counts]
    return [math.log(counts[1][p] / sums[1][p // WIDTH]) - math.log(counts[0][p] / sums[0][p // WIDTH]) for p in range(N_CLASSES * WIDTH * WIDTH)]


def scan_secrets(docs: DataFrame, samples: DataFrame | None = None, threshold: float = 0.5, min_value: int = 8, keep: bool = False) -> DataFrame:
    """All secrets of each text: doc_id, text (null: empty), base (array of spans) and spans (with the Markov ones).

    base: assign, access and hex matches. Markov: runs of 16 or more identifier characters between base spans whose
    mean log-likelihood ratio, random over ordinary, is above ``threshold``; in other runs, the parts of that length
    between / = _ - that are above it. Spans are ordered by start, then kind. Rows of ``docs`` stay one to one, repeats included; an empty table gives none; a text without matches
    has empty arrays; other columns are ignored, or come in a struct ``kept`` where ``keep`` asks for them."""
    kept = [F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("kept")] if keep else []
    also = ["kept"] * keep
    table = markov_table(labelled_samples(docs).where("not held_out") if samples is None else samples)
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *kept)
    text = F.col("text")
    base = F.concat(
        spans_of(text, ASSIGN, "assign", accept=lambda v: F.length(v) >= min_value),
        spans_of(text, ACCESS, "access"),
        spans_of(text, HEX, "hex"),
    )
    d = d.select("doc_id", "text", F.sort_array(base).alias("base"), *also)
    d = d.select("*", _blanked(F.col("text"), F.col("base")).alias("rest"))
    # each run with the parts inside it, so that a part is held against its own run only
    within = lambda t: F.filter(F.transform(spans_of(t["value"], PART, "markov"), lambda p: _moved(p, t["start"])), lambda p: p["end"] - p["start"] < t["end"] - t["start"])
    runs = F.transform(spans_of(F.col("rest"), TOKEN, "markov"), lambda t: F.struct(t.alias("run"), within(t).alias("parts")))
    d = d.select("doc_id", "text", "base", runs.alias("runs"), *also)
    random = lambda value: f"{_ratio(value, _literal(table))} > {threshold:f}"
    found = F.expr(f"flatten(transform(runs, x -> if({random('x.run.value')}, array(x.run), filter(x.parts, p -> {random('p.value')}))))")
    return d.select("doc_id", "text", "base", F.sort_array(F.concat("base", found)).alias("spans"), *also)


def span_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with each of ``spans`` (ordered by start) replaced by ``mask``; overlapping spans share a mask."""
    return replaced(text, spans, lambda p: F.when(p["joined"], F.lit("")).otherwise(F.lit(mask)))


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of ``spans`` (ordered by start); all else keeps its place."""
    return replaced(text, spans, lambda p: F.repeat(F.lit(" "), p["end"] - p["start"]))


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in their texts masked, and n_chars (where they have it) set anew for changed texts.

    Rows and columns stay; a null text stays null."""
    found = F.size("spans") > 0
    scanned = scan_secrets(docs, keep=True).withColumn("masked", F.when(found, redacted(F.col("text"), F.col("spans"), mask)))
    new = {"text": F.coalesce("masked", "kept.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("masked").cast(docs.schema["n_chars"].dataType), F.col("kept.n_chars"))
    return scanned.select(*(new.get(n, F.col(f"kept.`{n}`")).alias(n) for n in docs.columns))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
