"""The engine as one object: health, taxonomy, facets, browsing, search and explanations over a catalogue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facets as fc
from ..operators import retrieve as rt
from ..operators import judge, sparse_index, vector_index
from ..operators.enrich import Client, text_chunk
from ..operators.filters import Selection, browse, catalogue_view, matches
from ..operators.judge import DEFAULT_REASON
from ..operators.sparse_index import Analyser, SparseIndex
from ..operators.vector_index import VectorIndex
from ..schema import CANDIDATES, DEFAULT_ALPHA, MAX_LIMIT, REFINED
from ..sources.commits import Commits
from ..sources.storage import stored


@dataclass
class Engine:
    """catalogue: id, company_name, hq_country, expos, category ids and cat_tree; texts: (id, text); vectors: (id, vector).

    With stored indexes of the catalogue's texts and vectors (seed), searches read these instead of the tables. A vector index is read in
    its exact way where nothing is filtered; under a filter the best may be excluded from its lists, so the vectors are read.
    """

    catalogue: DataFrame
    texts: DataFrame
    vectors: DataFrame
    text_index: SparseIndex | None = None
    vector_index: VectorIndex | None = None

    def __post_init__(self) -> None:
        self.catalogue = catalogue_view(self.catalogue)

    @staticmethod
    def seed(catalogue: DataFrame, vectors: DataFrame, path: str, *, texts: DataFrame | None = None, analyser: Analyser = Analyser(), force: bool = False, **vector_options: int) -> Engine:
        """One job from entities to an engine over stored indexes below path: the catalogue, its texts as an inverted index, its vectors as
        lists. texts are by default the chunks of the entities (enrich.text_chunk). What is there already is opened, unless force; an
        index counts once all its parts are written, and readers of the one before keep it."""
        spark = catalogue.sparkSession
        commits = Commits(spark, path)
        number, last = commits.last()
        if last and not force:
            return Engine.open(spark, path)
        folder = commits.folder("index")
        catalogue.write.parquet(f"{folder}/catalogue")
        kept = spark.read.schema(catalogue.schema).parquet(f"{folder}/catalogue")
        ids = kept.select("id")
        chunks = kept.select("id", text_chunk().alias("text")) if texts is None else texts.select("id", "text").join(ids, "id", "left_semi")
        chunks.write.parquet(f"{folder}/texts")
        sparse_index.build(spark.read.parquet(f"{folder}/texts"), f"{folder}/terms", analyser=analyser)
        vectors.select("id", "vector").join(ids, "id", "left_semi").write.parquet(f"{folder}/vectors")
        vector_index.build(spark.read.parquet(f"{folder}/vectors"), f"{folder}/lists", **vector_options)
        while not commits.add(number + 1, {"folder": folder}):
            number = commits.last()[0]
        return Engine.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Engine:
        """The engine that seed wrote last below path."""
        folder = Commits(spark, path).last()[1].get("folder")
        if not folder:
            raise FileNotFoundError(f"no index at {path}")
        tables = [spark.read.parquet(f"{folder}/{t}") for t in ("catalogue", "texts", "vectors")]
        return Engine(*tables, SparseIndex(spark, f"{folder}/terms"), VectorIndex(spark, f"{folder}/lists"))

    def health(self) -> dict[str, object]:
        return {"status": "ok", "count": self.catalogue.count()}

    def taxonomy(self) -> DataFrame:
        return fc.taxonomy(self.catalogue)

    def facets(self, selection: Selection) -> DataFrame:
        """Counts of all dimensions, the most frequent values first."""
        return fc.ranked(fc.facets(self.catalogue, selection, self.taxonomy())).orderBy("dim", "pos")

    def browse(self, selection: Selection, *, limit: int = 10, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        return browse(self.catalogue, selection, limit=min(max(limit, 1), MAX_LIMIT), offset=offset)

    def search(
        self, queries: DataFrame, query_vectors: DataFrame, selection: Selection = Selection(), *, limit: int = 5, candidates: int = CANDIDATES,
        fusion: str = "rrf", judged: DataFrame | None = None, alpha: float = DEFAULT_ALPHA, normalise: str = "minmax", client: Callable[[], Client] | None = None,
    ) -> DataFrame:
        """Ranked rows of each query (query_id, text) and (query_id, vector): both branches under the filter, fused, and reranked if
        judged (query_id, id, judge) is given, or by the judgements of a client. An offset has no meaning here; a blank query finds nothing, use browse."""
        limit = min(max(limit, 1), MAX_LIMIT)
        allowed = self.catalogue.filter(matches(selection)).select("id")
        asked = queries.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
        narrow = lambda df: df.join(allowed, "id", "left_semi")
        wanted = query_vectors.join(asked.select("query_id"), "query_id", "left_semi")
        if self.text_index is not None:
            sparse = self.text_index.best(asked, candidates, allowed=None if selection == Selection() else allowed)
        else:
            sparse = rt.top(rt.bm25(narrow(self.texts), asked, candidates, corpus=self.texts), candidates)
        if self.vector_index is not None and selection == Selection():
            dense = self.vector_index.search(wanted, candidates, exact=True)
        else:
            dense = rt.top(rt.dense(narrow(self.vectors), wanted, candidates), candidates)
        depth = max(2 * limit, 20) if judged is not None or client is not None else limit
        ranked = rt.top(rt.fused(dense, sparse, fusion), max(limit, depth))
        if client is not None and judged is None:
            ranked = stored(ranked, "shortlist")
            judged = judge.judgements(ranked, asked, self._cards(), client)
        if judged is not None:
            ranked = rt.rerank(ranked, judged, alpha=alpha, normalise=normalise, top_n=limit)
        return ranked.join(self.catalogue, "id")

    def answer(self, query: str, vector: list[float] | None, selection: Selection = Selection(), *, limit: int = 10, offset: int = 0, **search) -> DataFrame:
        """The rows for one query: without words the browsing page, else the search with its scores."""
        if not (query or "").strip():
            return self.browse(selection, limit=limit, offset=offset)[0]
        spark = self.catalogue.sparkSession
        asked = spark.createDataFrame([(0, query)], "query_id long, text string")
        vectors = spark.createDataFrame([(0, vector)] if vector else [], "query_id long, vector array<float>")
        return self.search(asked, vectors, selection, limit=limit, **search)

    def _cards(self) -> DataFrame:
        """The catalogue with all columns of a candidate's card."""
        missing = {"about": "string", "refined": REFINED, "cat_l1_names": "array<string>", "cat_l2_names": "array<string>"}
        return self.catalogue.withColumns({c: F.lit(None).cast(kind) for c, kind in missing.items() if c not in self.catalogue.columns})

    def explained(self, shortlist: DataFrame, queries: DataFrame, client: Callable[[], Client] = judge.StubJudge) -> DataFrame:
        """The shortlist (query_id, id, rank) with the reasons that a client gives, or DEFAULT_REASON."""
        return judge.reasons(shortlist, queries, self._cards(), client)

    def explain(self, shortlist: DataFrame, explanations: DataFrame) -> DataFrame:
        return rt.explained(shortlist, explanations, DEFAULT_REASON)
