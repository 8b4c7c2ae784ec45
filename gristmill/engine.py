"""The engine: tables in, plans, questions, SQL, documents and reports out."""

from __future__ import annotations

import html
import math
from dataclasses import asdict
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import timing
from gristmill.ask.cards import build_cards
from gristmill.ask.planner import Answer, Conversation, Model, schema_text
from gristmill.ask.routing import empty_hint, route, without_chart_words
from gristmill.catalog import Card, Catalog, Relationship
from gristmill.columns import is_date, is_number, qcol
from gristmill.documents import Documents, Embedder
from gristmill.functions.dates import content_date, filename_asof
from gristmill.functions.numbers import clip_negative, echoes
from gristmill.functions.text import register, tokens_of
from gristmill.operators import aggregates as A
from gristmill.operators import ordering as O
from gristmill.operators import retrieval as H
from gristmill.plans.compiler import Compiled, compile_plan
from gristmill.plans.ir import Plan
from gristmill.plans.sqltier import TimeLimit, run_sql, spell_literals
from gristmill.session import stored
from gristmill.sources import files
from gristmill.sources.store import Manifest, Store, StoreConflict

TEXT_ROWS, TABLE_ROWS = 100, 2000
SECONDS = 20.0
#: Rows up to which a result is put in words, and up to which it is without being asked.
PHRASED_ROWS, SHORT_ROWS = 40, 3
# Words that ask for words.
PROSE_WORDS = frozenset("explain describe summarise summarize why tell".split())


class Engine:
    """One catalogue of tables and one store of text chunks over a Spark session.

    ``warnings`` tells of files whose name and content have different days. ``embedder`` maps texts
    to vectors, in the executors; ``embedding`` names it, for vectors are kept by that name.
    """

    def __init__(self, spark: SparkSession, model: Model | None = None, seconds: float = SECONDS, rules: files.HouseRules | None = None, embedder: Embedder | None = None, embedding: str = ""):
        self.spark, self.seconds, self.model = spark, seconds, model
        self.catalog = Catalog(spark)
        self.documents = Documents(embedder, embedding)
        self.origin: dict[str, str] = {}  # table -> the file that it came from
        self.opened: tuple[str, Manifest] | None = None  # the folder and version this engine is of
        self._kept: dict[str, DataFrame] = {}  # tables as they are in that version
        self._dropped: set[str] = set()
        self.conversation = Conversation(self.catalog, model, rules)
        self.warnings: list[str] = []
        register(spark)

    def load(self, paths: list[str] | str, split: bool = False) -> list[str]:
        """Read files, folders and patterns into the catalogue; texts become chunks. A file read
        again replaces what it gave before."""
        added, texts = [], []
        for path in files.collect_paths([paths] if isinstance(paths, str) else paths):
            if path.lower().endswith(files.TEXTS):
                texts.append(path)
                added.append(path.rsplit("/", 1)[-1])
                continue
            file, found = path.rstrip("/").rsplit("/", 1)[-1], files.read_file(self.spark, path, split)
            for name in [n for n, f in self.origin.items() if f == file and n not in found]:
                self.remove(name)
            for name, df in found.items():
                day = self.spark.range(1).select(filename_asof(F.lit(name)).alias("d")).first()["d"]
                self.catalog.add(name, df, Card(as_of=str(day) if day else None))
                self.origin[name] = file
                self._compare_days(name, df, day)
                added.append(name)
        if texts:
            self.chunks = H.build_chunks(files.read_texts(self.spark, texts), "text", ["source", "location"])
        return added

    def remove(self, name: str) -> None:
        """Forget a table; the next save leaves it out."""
        self.catalog.remove(name)
        self.origin.pop(name, None)
        self._dropped.add(name)

    @property
    def chunks(self) -> DataFrame | None:
        """The chunks of all documents."""
        return self.documents.chunks

    @chunks.setter
    def chunks(self, new: DataFrame) -> None:
        """Take up chunks, in place of those that their sources had."""
        self.documents.add(new)
        self.catalog.chunk_count = self.documents.count

    def _compare_days(self, name: str, df: DataFrame, named: date | None) -> None:
        """Warn if a table's most constant date is another day than its file's name says."""
        columns = [f.name for f in df.schema if is_date(f.dataType)]
        found = content_date(df, columns).first() if named and columns else None
        if found and found["day"] != named:
            self.warnings.append(f"{name} is named after {named}, but {found['column']} says {found['day']}")

    def describe(self) -> dict[str, Card]:
        """Make a card for each table that has none for its columns."""
        return build_cards(self.catalog, lambda names: schema_text(self.catalog, names, detail=True), self.model)

    def add(self, name: str, df: DataFrame, card: Card | None = None) -> None:
        self.catalog.add(name, df, card)

    def plan(self, plan: dict | Plan, as_at: date | None = None) -> DataFrame:
        return self.compile(plan, as_at).df

    def compile(self, plan: dict | Plan, as_at: date | None = None) -> Compiled:
        return compile_plan(plan, self.catalog, as_at)

    def ask(self, question: str) -> Answer:
        """An answer in rows, as a chart, or from documents, or options to choose from; with the
        seconds of each step, and a hint where nothing was found. All of it together keeps to the
        engine's time limit; the rows of an answer are fetched later, under a limit of their own."""
        timing.snapshot(clear=True)
        with self.limit() as limit:
            try:
                answer = self._answer(question)
            except Exception:
                if not limit.expired:
                    raise
                answer = Answer("none", text=f"The question took more than {self.seconds:g} seconds and was stopped.", tier="stopped")
        answer.seconds = timing.snapshot(clear=True)
        return answer

    def _answer(self, question: str) -> Answer:
        way = "analyze" if self.conversation.pending else route(question, self.catalog, self.documents.count > 0)
        if way == "chat":
            answer = Answer("chat", text="Ask about the tables or the documents that are loaded.")
        elif way == "docs":
            answer = self._from_documents(question)
        else:
            answer = self.conversation.ask(without_chart_words(question) if way == "plot" else question)
            if way == "plot" and answer.kind == "rows":
                answer = self._as_chart(answer, question)
        if answer.kind == "rows" and answer.plan is not None and answer.tier != "explained":
            with timing.stage("hint"):
                answer.hint = self._hint(answer)
            with timing.stage("phrasing"):
                answer.text = answer.text or self._phrased(question, answer)
        return answer

    def _as_chart(self, answer: Answer, question: str) -> Answer:
        if answer.plan is None or not answer.plan.group_by or not answer.compiled.df.columns:
            return answer
        words = set(tokens_of(question))
        answer.chart = self._chart_of(answer.compiled.df, next((k for k in ("pie", "line") if k in words), ""))
        answer.kind = "chart"
        return answer

    def _hint(self, answer: Answer) -> str:
        """Why nothing was found, if the filters of a plan leave no row."""
        steps = [df for name, df in answer.compiled.steps[:-1]]
        if not answer.plan.filters or not steps or not steps[-1].isEmpty():
            return ""
        return empty_hint(answer.plan, self.catalog)

    def _phrased(self, question: str, answer: Answer) -> str:
        """A few rows in a model's words, if they are few or words are asked for, and only with their own numbers."""
        if self.model is None:
            return ""
        rows = answer.compiled.df.limit(PHRASED_ROWS + 1).collect()
        wanted = set(tokens_of(question)) & PROSE_WORDS
        if len(rows) > PHRASED_ROWS or len(rows) > SHORT_ROWS and not wanted:
            return ""
        table = "\n".join([" | ".join(answer.compiled.df.columns), *(" | ".join("" if v is None else str(v) for v in r) for r in rows)])
        said = self.model([{"role": "system", "content": "Put the result in one or two sentences. Use its numbers as they are and no others."}, {"role": "user", "content": f"{question}\n{table}"}])
        return said if echoes(said, f"{table} {question}") else ""

    def _from_documents(self, question: str) -> Answer:
        """The chunks that fit a question best, how well they do, and a model's words on them."""
        with timing.stage("retrieval"):
            found = stored(self.retrieve(question))
            rows = found.select("source", "chunk", "sparse", "dense").collect()
        text = "" if rows else "No document says anything on this."
        if self.model is not None and rows:
            context = "\n\n".join(f"[{r['source']}] {r['chunk']}" for r in rows)[: H.CONTEXT_CHARS]
            with timing.stage("model answer"):
                text = self.model([{"role": "system", "content": "Answer from these passages only, and name their sources."}, {"role": "user", "content": f"{context}\n\nQuestion: {question}"}])
        return Answer("docs", text=text, docs=found, confidence=self._sureness(question, rows), tier="documents")

    def _sureness(self, question: str, rows: list) -> float:
        """The mean likeness of the chunks found: their cosines, or without vectors their BM25
        scores as a share of what a chunk full of the question's words would have."""
        near = [max(0.0, r["dense"]) for r in rows if r["dense"] is not None]
        if near:
            return sum(near) / len(near)
        scores = [r["sparse"] or 0.0 for r in rows]
        n = self.documents.count
        # a term in one chunk only weighs ln(1 + (n - 0.5) / 1.5), and its count at most k1 + 1 times that
        most = len(set(tokens_of(question))) * (H.K1 + 1) * math.log(1 + (n - 0.5) / 1.5) if n else 0.0
        return sum(scores) / len(scores) / most if scores and most else 0.0

    def sql(self, text: str, spell: bool = True) -> DataFrame:
        """A guarded query; with ``spell``, text literals take the spelling that the tables have."""
        return run_sql(self.catalog, spell_literals(self.catalog, text)[0] if spell and "'" in text else text)

    def chart(self, plan: dict | Plan, most: int = 15, kind: str = "") -> dict:
        """A chart of a plan with one group and one measure: its kind and its (label, value) rows,
        the smaller ones beyond ``most`` together as Other. The kind asked for (pie, line, bar,
        barh, area, scatter) is taken; without one, few labels stand and many lie."""
        return self._chart_of(self.compile(plan).df, kind, most)

    @staticmethod
    def _chart_of(df: DataFrame, kind: str = "", most: int = 15) -> dict:
        label, value = df.columns[0], df.columns[-1]
        if kind in ("line", "area", "scatter"):  # a series along its labels, each as it is
            return {"kind": kind, "x": label, "y": value, "data": df.select(qcol(label), qcol(value)).orderBy(qcol(label).asc_nulls_last())}
        data = A.topn_other(df.withColumn(label, qcol(label).cast("string")), label, value, most)
        if kind == "pie":
            data = data.withColumn(data.columns[-1], clip_negative(qcol(data.columns[-1])))
        return {"kind": kind or ("bar" if data.count() <= 8 else "barh"), "x": label, "y": value, "data": data}

    def limit(self, seconds: float | None = None) -> TimeLimit:
        """A context in which Spark jobs are cancelled after the engine's time limit."""
        return TimeLimit(self.catalog, seconds or self.seconds)

    def retrieve(self, query: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None, k: int = H.TOP) -> DataFrame:
        """The k best chunks for a query: BM25 from the index, fused with the nearest chunks if
        there is an embedder or ``vectors`` (chunk_id, embedding) and the query's vector are given.

        Beside the fused ``score`` stand ``sparse`` and ``dense``, the scores of each list.
        """
        if not self.documents.count:
            raise ValueError("no documents are loaded")
        lists = {"sparse": (self.documents.sparse(query), H.SPARSE_WEIGHT)}
        if vectors is not None and query_vector is not None:
            lists["dense"] = (H.dense_topk(vectors, query_vector, H.FETCH, "chunk_id"), H.DENSE_WEIGHT)
        elif self.documents.embedder is not None:
            near = self.documents.dense(self.documents.embedder([query])[0])
            if near is not None:
                lists["dense"] = (near, H.DENSE_WEIGHT)
        lists = {name: (stored(rows), weight) for name, (rows, weight) in lists.items()}  # FETCH rows each
        fused = H.rrf_fuse(list(lists.values()), top=k)
        for name in ("sparse", "dense"):
            one = lists[name][0].withColumnRenamed("score", name) if name in lists else None
            fused = fused.withColumn(name, F.lit(None).cast("double")) if one is None else fused.join(one, "id", "left")
        return self.documents.hits(fused)

    def reports(self) -> dict[str, object]:
        """Names of the standing reports and functions that make them."""
        out: dict[str, object] = {"inventory": lambda: A.inventory({n: t.df for n, t in self.catalog.tables.items() if t.long_of is None})}
        for name, table in self.catalog.tables.items():
            if table.long_of is not None:
                continue
            out[f"{name}: overview"] = lambda t=table: O.head(t.df, 200).select(*[qcol(c) for c in t.columns])
            numbers = [f.name for f in table.df.schema if is_number(f.dataType) and f.name in table.columns]
            if numbers:
                out[f"{name}: figures"] = lambda t=table, n=numbers: A.describe_numeric(t.df.select(*[qcol(c) for c in n]))
                out[f"{name}: by category"] = lambda t=table: self._by_category(t)
        if self.documents.count:
            out["documents"] = lambda: A.pages_of(self.chunks)
        return out

    @staticmethod
    def _by_category(table) -> DataFrame | None:
        rows = table.df.select(*[qcol(c) for c in table.columns])
        amount, categories = A.best_amount_column(rows), A.category_columns(rows)
        return A.report_sum_count(rows, categories[0], amount) if amount and categories else None

    def charts(self, most: int = 4) -> list[dict]:
        """Specs of a dashboard's charts, each with its rows as a lazy frame."""
        out = []
        for name, table in self.catalog.tables.items():
            if table.long_of is not None or len(out) == most:
                continue
            rows = table.df.select(*[qcol(c) for c in table.columns])
            amount, categories = A.best_amount_column(rows), A.category_columns(rows)
            if amount and categories:
                out.append({"title": f"{amount} by {categories[0]}", "table": name, "kind": "bar", "data": A.chart_topk(rows, categories[0], amount)})
        return out

    def save(self, folder: str, replace: bool = False) -> int:
        """Make a new version of the store and return its number.

        Tables and documents that the store has and this engine never took up or loaded stay
        (all go with ``replace``); what was loaded anew takes the place of what its file gave
        before. Tables that are as they were opened are not written again. Earlier versions
        stay readable; a save that dies changes nothing.
        """
        store = Store(self.spark, folder)
        base = store.read()
        if not base.number and files.exists(self.spark, f"{folder}/tables") and not replace and (self.opened is None or self.opened[0] != folder):
            self._beside_unversioned(folder)
        mine = self.opened[1] if self.opened and self.opened[0] == folder else Manifest()
        made = Manifest() if replace else base.copy()
        for name in self._dropped:
            made.tables.pop(name, None)
        loaded = set(self.origin.values())
        for name in [n for n, e in made.tables.items() if e.get("source") in loaded and n not in self.catalog.tables]:
            made.tables.pop(name)  # a sheet that its file has no more
        for name, table in self.catalog.tables.items():
            if table.long_of is not None:
                continue
            entry = mine.tables.get(name, {}) if self._kept.get(name) is table.df else {}
            if not entry.get("path"):
                entry = {"path": store.write(table.df, "table")}
                stored_ = store.frame(entry["path"])
                table.__dict__.setdefault("rows", stored_.count())
            if not entry.get("values"):
                values = self.catalog.values_of(name)
                entry["values"] = store.write(values, "values") if values is not None else None
                entry["tokens"] = store.write(self.catalog.tokens_of(name), "tokens") if values is not None else None
            made.tables[name] = {**entry, **self.catalog.metadata(name), "source": self.origin.get(name, "")}
        here = {k for k in made.tables if k in self.catalog.tables}
        others = [k for k in made.links if not {k["child_table"], k["parent_table"]} <= here]
        made.links = others + [asdict(k) for k in self.catalog.links]
        seen = {d["path"] for d in mine.documents}
        theirs = [] if replace else [p for p in Documents.open(store, base, self.documents.embedder, self.documents.model).parts if not p.entry or p.entry["path"] not in seen]
        if {d["path"] for d in base.documents} < seen or any(d in mine.documents for d in base.documents) and [d for d in mine.documents if d not in base.documents]:
            raise StoreConflict(f"{folder} was changed since it was opened; open it again")
        self.documents.beside(theirs)
        made.vectors = list(base.vectors)
        self.documents.save(store, made)
        made = store.commit(made, base)
        self.opened, self._dropped = (folder, made), set()
        self._kept = {n: t.df for n, t in self.catalog.tables.items() if t.long_of is None}
        self.catalog.chunk_count = self.documents.count
        if "://" not in folder:
            self.conversation.keep_in(f"{folder}/plans.json")
        return made.number

    def _beside_unversioned(self, folder: str) -> None:
        """Take up what a store without versions has besides what was loaded here."""
        other = Engine(self.spark)
        other.open(folder)
        for name, table in other.catalog.tables.items():
            if table.long_of is None and name not in self.catalog.tables:
                self.catalog.add(name, table.df, table.card)
        if other.documents.count:
            self.documents.parts = other.documents.parts + self.documents.parts

    def open(self, folder: str, version: int | None = None) -> list[str]:
        """Take up a version of a store, the last one if none is named."""
        store = Store(self.spark, folder)
        made = store.read(version)
        if not made.number:
            return self._open_unversioned(folder)
        for name, entry in made.tables.items():
            self.catalog.add(name, store.frame(entry["path"]))
            self.catalog.take_metadata(name, entry)
            if entry.get("values"):
                self.catalog.take_values(name, store.frame(entry["values"]), store.frame(entry["tokens"]) if entry.get("tokens") else None)
            if entry.get("source"):
                self.origin[name] = entry["source"]
        self.catalog.links = [Relationship(**k) for k in made.links]
        self.documents = Documents.open(store, made, self.documents.embedder, self.documents.model)
        self.catalog.chunk_count = self.documents.count
        self.opened = (folder, made)
        self._kept = {n: self.catalog.tables[n].df for n in made.tables}
        if "://" not in folder:
            self.conversation.keep_in(f"{folder}/plans.json")
        return list(made.tables)

    def _open_unversioned(self, folder: str) -> list[str]:
        """Take up a store of before there were versions: folders of tables, values and chunks."""
        names = []
        for name, df in files.load_tables(self.spark, f"{folder}/tables").items():
            self.catalog.add(name, df)
            names.append(name)
        if files.exists(self.spark, f"{folder}/chunks"):
            self.chunks = self.spark.read.parquet(f"{folder}/chunks")
        if files.exists(self.spark, f"{folder}/values"):
            self.catalog.take_index(self.spark.read.parquet(f"{folder}/values"))
        self.catalog.load_metadata(f"{folder}/metadata.json")
        if "://" not in folder:
            self.conversation.keep_in(f"{folder}/plans.json")
        return names


def condensed(df: DataFrame) -> tuple[DataFrame, dict[str, str | None]]:
    """A result for display: repeated rows with their number, constant columns lifted out."""
    df = A.collapse_duplicates(df) or df
    constants = {r["column"]: r["value"] for r in A.constant_columns(df).collect()}
    rest = [c for c in df.columns if c not in constants]
    return (df.select(*[qcol(c) for c in rest]), constants) if rest and constants else (df, {})


def as_text(df: DataFrame, rows: int = TEXT_ROWS) -> str:
    """The first rows as aligned text, with a note if there are more."""
    found = df.limit(rows + 1).collect()
    shown = [[("" if v is None else str(v)) for v in r] for r in found[:rows]]
    widths = [max([len(c), *(len(r[i]) for r in shown)]) for i, c in enumerate(df.columns)]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in [df.columns, *shown]]
    return "\n".join(lines + ([f"... more than {rows} rows"] if len(found) > rows else []))


def as_html(df: DataFrame, rows: int = TABLE_ROWS) -> str:
    found = df.limit(rows + 1).collect()
    cell = lambda v: "" if v is None else html.escape(str(v))
    head = "".join(f"<th>{cell(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in found[:rows])
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>" + (f"<p>more than {rows} rows</p>" if len(found) > rows else "")
