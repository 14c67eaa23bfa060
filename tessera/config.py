"""Settings of a search index."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class SearchConfig:
    """Weights of the character features, sizes of results and windows, and how texts are split.

    ``max_results`` bounds a result and also the vocabulary tokens that a query token expands to;
    ``window_slack`` widens a candidate's range of scored token places and bounds the candidates of
    a heatmap; ``adjacency_bonus`` is the share of a score that depends on how close matches lie;
    ``ignore_case`` concerns heatmaps alone, tokens are always in small letters.
    """

    ignore_case: bool = True
    max_ngram: int = 4
    anchor_weight: float = 1.0
    gestalt_weight: float = 1.0
    prefix_weight: float = 1.0
    fuzzy_weight: float = 1.0
    skip_weight: float = 1.0
    floating_weight: float = 1.0
    char_bag_weight: float = 4.0
    max_results: int = 10
    window_slack: int = 5
    adjacency_bonus: float = 0.5
    separator: str = r"[^\p{L}\d]+"
    have_store: bool = False

    def record(self) -> dict[str, object]:
        """The settings under the names of the snapshot format."""
        return {RECORD_NAMES[k]: v for k, v in asdict(self).items()}

    @classmethod
    def of_record(cls, record: dict[str, object]) -> SearchConfig:
        """The settings of a snapshot; names that it lacks have their defaults, others are ignored."""
        known = {f.name: f.type for f in fields(cls)}
        return cls(**{k: {"bool": bool, "int": int, "float": float, "str": str}[known[k]](record[name]) for k, name in RECORD_NAMES.items() if record.get(name) is not None})


RECORD_NAMES = {
    "ignore_case": "ignoreCase", "max_ngram": "maxNgramSize", "anchor_weight": "anchorWeight", "gestalt_weight": "gestaltWeight", "prefix_weight": "prefixWeight",
    "fuzzy_weight": "fuzzyWeight", "skip_weight": "skipWeight", "floating_weight": "floatingWeight", "char_bag_weight": "charBagWeight", "max_results": "maxResults",
    "window_slack": "topKVocab", "adjacency_bonus": "adjacencyBonus", "separator": "tokenizeRegexString", "have_store": "haveStore",
}
QUERY_TOKENS = 5
PREFIX_CAP = 8
