"""Template residue, filler, error pages and script notices.

Method: positive-unlabelled naive Bayes by expectation-maximization. Passages
that are residue beyond doubt (``SEEDS``) are the labelled positives of four
classes; all others are unlabelled. EM fits word and shape frequencies of the
four classes and of plain content; then every passage of every document is
scored and the record is decided from its passages:

* a sentence outside code that is a placeholder (and has the form of one, see
  ``FRAME``), or a paragraph made up of filler, is enough;
* as an error page or script notice a record is found only if such passages
  make up the text: at most ``MAX_CONTENT`` of its words stand in sentences of
  content. Lines without a sentence (titles, menus, buttons) count for neither.

EM uses the same view of a record: unlabelled passages of records that are
mostly content are no error pages or notices, whatever their words.

The model is fitted on a bounded sample of records, those of the smallest hashes
of the id: at most ``FIT_RECORDS``, with at most ``FIT_CHARACTERS`` in all, each
by its whole text. Every record is scored, by its whole text too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.markdown import code_lines

#: The documented bounds of the sample: records, and characters of all their texts.
FIT_RECORDS, FIT_CHARACTERS = 10_000, 40_000_000
ROUNDS = 5
MAX_CONTENT = 0.4
#: Pseudo-words, spread as in the whole sample, that each class gets besides its own.
BACKGROUND = 200.0
#: A line of at most so many words without the end of a sentence is a label (title, menu, button).
LABEL_WORDS = 9
PLACEHOLDER, FILLER, ERROR, NOTICE, CONTENT = range(5)

#: Forms in which template languages and authors write a place to be filled in, of any length. No form holds
#: another opening mark of its own, so that a passage is read once, however many marks it opens.
FRAME = re.compile(
    r"\{\{(?:(?!\{\{|\}\}).)*\}\}\}?|\{%(?:(?!\{%|%\}).)*%\}|<%(?:(?!<%|%>).)*%>|\$\{[^{}\n]+\}|\$\(\w[^()\n]*\)|#\{[^{}\n]+\}"
    r"|%\(\w+\)[a-z]|%[A-Za-z]\w*%|(?<![\w%])%[sd](?!\w)|(?<![\w{])\{[A-Za-z0-9][\w .-]*\}(?!\})|<<[^<>\n]+>>"
    r"|\[\[[^\[\]\n]+\]\]|@@\w+@@|__[A-Z]\w*?__|«[^«»\n]+»|\bX{2,}(?:-\w+-X{2,}|X\b)"
    r"|</?[A-Za-z][^<>\n]*>|<\|\w+\|>|(?<!\])\[[^\[\]\n]{2,}\](?![(\[:])"
)
#: A passage without any of these characters holds no frame.
MARKS = re.compile(r"[{<$#%\[@«]|__|XX")
CODE = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
TAGGED_CODE = re.compile(r"<(code|pre|kbd|samp|script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I)
ENDS = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*")
BLANK = re.compile(r"\n\s*\n")
STRIP = " \t>#*+-|_\u200b\ufeff"
#: Marker strings of tokenizers, which are no placeholders.
MARKERS = re.compile(r"</?(s|unk|pad|mask|bos|eos|cls|sep)>|<\|[^|>]*\|>|\[(CLS|SEP|PAD|MASK|UNK|BOS|EOS)\]", re.I)
WORD = re.compile(r"[^\W_]+|\x00")
WIDE = re.compile(r"[぀-ヿ㐀-鿿]{2,}")
DIGITS = re.compile(r"\d+")

#: Seeds: what is residue beyond doubt, by class, as a passage in lower case with digits as 0. They label; they decide nothing.
SEEDS = {
    PLACEHOLDER: re.compile(
        r"\{\{.+?\}\}|\{%.+?%\}|<%.+?%>|\$\{\w+\}|#\{\w+\}|%\(\w+\)s|\[\[\w+(:\w+)?\]\]|@@\w+@@|__replace_me__"
        r"|<<\w+>>|[\[<{](your|add|insert|inserte|tbd)\b[^\n]*?[\]>}]|xxx-\w+-xxx|\[object object\]"
    ),
    FILLER: re.compile(
        r"^lorem ipsum|^(your|put|write|add|insert) .{0,40}(content|text|example|summary|description|title)?.{0,20} here\.?$"
        r"|goes here\.?$|^(blah|asdf|text|test|foo)( (blah|asdf|qwer|text|test|foo))+|^\(?to be written|^placeholder (text|paragraph)"
        r"|^(todo|tbd|tba|fixme)\b|^coming soon|^dummy (text|copy)|^sample paragraph 0"
        r"|^aquí irá|^hier steht später|^le texte viendra"
    ),
    ERROR: re.compile(
        r"^(error )?[45]00? ?(error|not found|forbidden|bad gateway|internal server error|service unavailable)"
        r"|^(\S+ )?(0 )?(not found|forbidden|bad gateway|service unavailable|gateway time-?out|internal server error|too many requests|access denied)\W*$"
        r"|^(something went wrong|unexpected error|error 0)|^traceback \(most recent|^(incident|request|ref|trace id): [0-9a-f]+$"
        r"|^(error|erro|erreur|fehler) 0\b ?:?|^0 seite nicht|^please try again in 0|^check the address or go back"
        r"|^veuillez réessayer plus tard|^l'adresse demandée n'existe plus|^bitte versuchen sie es später|^die angeforderte adresse existiert"
        r"|^inténtelo de nuevo más tarde|^la dirección solicitada ya no|^tente (de novo|novamente) mais tarde|^o endereço (pedido|solicitado)"
        r"|^サーバーエラー|^お探しのページは|^しばらくしてからもう一度|^ページが見つかりません|^we can't find that page|^your session has expired"
        r"|^(the page you asked for was moved|we are updating the docs|you do not have permission to view)"
    ),
    NOTICE: re.compile(
        r"^(please )?(enable|activate|turn on|allow) (javascript|scripts)|^you need to (enable|allow) (javascript|scripts)|^javascript is (disabled|required)"
        r"|^(sorry, )?this \w+ (needs|requires|does not work without) (javascript|(client-side )?scripts)|^turn (them|scripts|javascript) on in your browser"
        r"|^checking your browser|^scripts and cookies must be|^loading the \w+…|^if nothing happens, (switch|turn) on|^(active|ative|activez|veuillez activer|bitte aktivieren sie) (o |le )?javascript|javascriptを有効"
    ),
}


def paragraphs(text: str) -> list[list[tuple[str, bool]]]:
    """The paragraphs of a text outside code as lists of (sentence, whether it is but a label).

    Entities are decoded; inline code becomes NUL. Headings are labels in a
    paragraph of their own.
    """
    if "&" in text:
        text = html.unescape(text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        lines = text.split("\n")
        text = "\n".join("" if code else line for line, code in zip(lines, code_lines(lines), strict=True))
    if "<" in text:
        text = TAGGED_CODE.sub("\x00", text)
    if "`" in text:
        text = CODE.sub("\x00", text)
    out = []
    for block in BLANK.split(text):
        now: list[tuple[str, bool]] = []
        for line in block.split("\n"):
            if not (bare := line.strip(STRIP)):
                continue
            label = line.lstrip()[:1] == "#" or (bare[-1:] not in ".!?…。！？:;,)" and bare.count(" ") < LABEL_WORDS)
            if label:
                if now:
                    out.append(now)
                    now = []
                out.append([(bare, True)])
                continue
            now.extend((p, False) for s in ENDS.split(bare) if (p := s.strip(STRIP)))
        if now:
            out.append(now)
    return out


def shape(frame: str) -> str:
    """The form of a frame: its words as a or A, its digits as 0."""
    return re.sub(r"[a-z]\w*", "a", re.sub(r"[A-Z][A-Z0-9]+\b|[A-Z][A-Z_0-9]+(?=__)", "A", DIGITS.sub("0", frame)))


def features(passage: str) -> list[str]:
    """Words in lower case with digits as 0, pairs of wide characters, and the shapes of frames."""
    low = DIGITS.sub("0", passage.lower())
    found = WORD.findall(low)
    if not low.isascii():
        for run in WIDE.findall(low):
            found.extend(run[i : i + 2] for i in range(len(run) - 1))
    if MARKS.search(passage):
        found.extend("⟦" + shape(m[0]) for m in FRAME.finditer(passage))
    return found


def seed_class(passage: str) -> int:
    """The class of a passage that is residue beyond doubt, else -1."""
    low = DIGITS.sub("0", passage.lower())
    return next((kind for kind, pattern in SEEDS.items() if pattern.search(low)), -1)


@dataclass(frozen=True)
class Model:
    """Log weights of each feature for the five classes, relative to the whole sample, and the classes' log priors.

    ``place`` gives a feature's row in ``weights``; row 0 is that of unknown
    features, which weigh nothing.
    """

    place: dict[str, int]
    weights: np.ndarray
    prior: np.ndarray


def fit(records: list[list[tuple]], rounds: int = ROUNDS) -> Model:
    """The model of a sample of records, by EM.

    A record is the list of its (sentence, label) pairs, or of triples with the
    seed class that is known already (-1 for none). Without any sentence
    everything is content.
    """
    bags, label, owner, plain = [], [], [], []
    for i, record in enumerate(records):
        for passage, is_label, *known in record:
            bag = features(passage)
            if bag:
                kind = known[0] if known else seed_class(passage)
                bags.append(bag)
                label.append(kind)
                owner.append(i)
                plain.append(not is_label)
    vocabulary = {w: i for i, w in enumerate(sorted({w for bag in bags for w in bag}))}
    lengths = np.array([len(b) for b in bags], dtype=np.int64)
    rows = np.repeat(np.arange(len(bags)), lengths)
    cols = np.fromiter((vocabulary[w] for bag in bags for w in bag), dtype=np.int64)
    label, owner, plain = np.array(label, dtype=np.int64), np.array(owner, dtype=np.int64), np.array(plain, dtype=bool)
    post = np.zeros((len(bags), 5))
    post[np.arange(len(bags)), np.where(label < 0, CONTENT, label)] = 1.0
    size, logs, prior = len(vocabulary), np.zeros((len(vocabulary), 5)), np.array([-9.0] * 4 + [0.0])
    total = np.bincount(cols, minlength=size).astype(float)
    spread = total / max(1.0, total.sum())
    free = label < 0
    for _ in range(rounds if len(bags) else 0):
        counts = np.stack([np.bincount(cols, weights=post[rows, k], minlength=size) for k in range(5)], axis=1)
        share = (counts + BACKGROUND * spread[:, None]) / (counts.sum(axis=0) + BACKGROUND)
        logs = np.log(share / spread[:, None])
        prior = np.log((post.sum(axis=0) + 1.0) / (post.sum() + 5.0))
        score = np.stack([np.bincount(rows, weights=logs[cols, k], minlength=len(bags)) for k in range(5)], axis=1) + prior
        new = np.exp(score - score.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        post[free] = new[free]
        # The record's view: what stands among content is no error page and no notice.
        words = lengths * plain
        content = np.bincount(owner, weights=words * post[:, CONTENT], minlength=len(records))
        bad = np.bincount(owner, weights=words * (post[:, ERROR] + post[:, NOTICE]), minlength=len(records))
        among = free & (content > bad)[owner]
        post[among, CONTENT] += post[among, ERROR] + post[among, NOTICE]
        post[among, ERROR] = post[among, NOTICE] = 0.0
    return Model({w: i + 1 for w, i in vocabulary.items()}, np.concatenate([np.zeros((1, 5)), logs]).astype(np.float32), prior)


def classes(passages: list[str], model: Model) -> tuple[list[int], list[int]]:
    """(class, number of features) of each passage; content if nothing speaks for another class.

    All passages are scored at once, as the product of the passages' features with the weights.
    """
    if not passages:
        return [], []
    known, ids, sizes = model.place.get, [], []
    for passage in passages:
        found = features(passage)
        sizes.append(len(found))
        ids.extend([known(w, 0) for w in found])
    ends = np.concatenate(([0], np.cumsum(sizes)))
    sums = np.concatenate((np.zeros((1, 5)), np.cumsum(model.weights[np.array(ids, dtype=np.int64)], axis=0, dtype=np.float64)))
    scores = sums[ends[1:]] - sums[ends[:-1]] + model.prior
    best = scores[:, :CONTENT].argmax(axis=1)
    best[scores[:, CONTENT] >= scores[:, :CONTENT].max(axis=1) - 1e-9] = CONTENT
    return best.tolist(), sizes


def is_placeholder(passage: str) -> bool:
    """Whether a passage holds a frame that is not a tokenizer's marker."""
    return any(not MARKERS.fullmatch(m[0]) for m in FRAME.finditer(passage))


def verdict(record: list[list[tuple[str, bool]]], kinds: list[int], sizes: list[int]) -> int | None:
    """The class of a record from the classes and sizes of its passages, or None if it is real content."""
    words, at = [0] * 5, 0
    for paragraph in record:
        filler = size = 0
        for passage, label in paragraph:
            kind, n = kinds[at], sizes[at]
            at += 1
            if kind == PLACEHOLDER:
                if is_placeholder(passage):
                    return kind
                kind = CONTENT
            if label and kind in (CONTENT, FILLER):
                continue
            size += n
            filler += n * (kind == FILLER)
            words[kind] += n
        if filler > 0.6 * size:
            return FILLER
    bad = words[ERROR] + words[NOTICE]
    if bad and words[CONTENT] <= MAX_CONTENT * (bad + words[CONTENT]):
        return ERROR if words[ERROR] >= words[NOTICE] else NOTICE
    return None


def decide(texts: list[str], model: Model) -> list[int | None]:
    """The class of each text, or None if it is real content; empty and blank texts are None."""
    records = [paragraphs(t) for t in texts]
    kinds, sizes = classes([p for r in records for paragraph in r for p, _ in paragraph], model)
    out, at = [], 0
    for record in records:
        n = sum(map(len, record))
        out.append(verdict(record, kinds[at : at + n], sizes[at : at + n]))
        at += n
    return out


def fitted(records: DataFrame, id_col: str, text_col: str, bound: int = FIT_RECORDS, characters: int = FIT_CHARACTERS) -> Model:
    """The model from a sample of records with text, those of the smallest id hashes.

    The sample ends before it has more than ``bound`` records or ``characters``
    characters; a record longer than all of ``characters`` is passed over.
    """
    usable = records.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (F.length(text_col) <= characters))
    # Hashes and lengths alone choose the sample; then one filter on the texts, without a sort or shuffle of them.
    first = usable.select(F.xxhash64(id_col).alias("h"), F.length(text_col).alias("n")).orderBy("h", "n").limit(bound).collect()
    whole = np.searchsorted(np.cumsum([r["n"] for r in first]), characters, side="right")
    last = first[whole - 1]["h"] if whole else None
    chosen = usable.where(F.xxhash64(id_col) <= F.lit(last)).select(F.col(text_col).alias("t"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[x for paragraph in paragraphs(t) for x in paragraph] for t in batch.column(0).to_pylist()]
            texts, labels = ([[x[i] for x in r] for r in rows] for i in (0, 1))
            seeds = [[seed_class(p) for p in r] for r in texts]
            kinds = (pa.string(), pa.bool_(), pa.int8())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.list_(k)) for v, k in zip((texts, labels, seeds), kinds, strict=True)], ["p", "l", "k"])

    # Rows with the last id hash are few more than counted only where an id is repeated.
    found = chosen.mapInArrow(split, "p array<string>, l array<boolean>, k array<tinyint>").collect()
    return fit([list(zip(r["p"], r["l"], r["k"], strict=True)) for r in found])


#: Records whose passages are scored at once.
BATCH = 128
NAMES = {PLACEHOLDER: "placeholder", FILLER: "filler", ERROR: "error_page", NOTICE: "script_notice"}


def residue(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, residue) of each record that is residue; residue is one of ``NAMES``.

    Null, empty and blank texts and null ids are no cases; an id that occurs
    several times is judged row by row. An empty table gives an empty result.
    """
    model = records.sparkSession.sparkContext.broadcast(fitted(records, id_col, text_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                kinds = decide(part.column(1).to_pylist(), model.value)
                hits = [(i, NAMES[k]) for i, k in zip(part.column(0).to_pylist(), kinds, strict=True) if k is not None]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in hits], pa.int64()), pa.array([k for _, k in hits], pa.string())], ["id", "residue"])

    slim = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return slim.where("id is not null and text is not null").mapInArrow(score, "id bigint, residue string")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id")).distinct()


def p9_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the records found."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = residue(documents).select(F.col("id").alias("doc_id")).distinct()
    return documents.select("doc_id", "source", "lang", "text").join(found, "doc_id", "left_anti")


def p9_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records the operator finds, how many of them hold a seed passage, and how many records with one it keeps."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = residue(documents).select(F.col("id").alias("found_id"), "residue").distinct()

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [any(seed_class(p) >= 0 for paragraph in paragraphs(t) for p, _ in paragraph) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.bool_())], ["doc_id", "seeded"])

    marked = documents.where("text is not null").select("doc_id", "text").mapInArrow(seeded, "doc_id bigint, seeded boolean")
    joined = marked.join(found, F.col("doc_id") == F.col("found_id"), "left")
    return joined.groupBy(F.coalesce("residue", F.lit("content")).alias("decision"), "seeded").agg(F.count(F.lit(1)).alias("records"))


QUERIES = {"p9_found": p9_found, "p9_corpus": p9_corpus, "p9_seeds": p9_seeds}
ORACLES: dict[str, str] = {}
