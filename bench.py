"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import time

from tracklens.session import local_session

HEADLINE = ["recommend_favourites", "nearest", "feedback_totals", "sessions", "calibrated_ratings", "rank_uniform", "ndcg", "session_pairs", "auc", "similar_titles"]
#: Timed too, but not part of the total, which stays comparable between rounds.
MORE = ["candidate_neighbours", "selected_edges", "novel_stations", "graph_recommendations"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    from tracklens.plans.registry import QUERIES

    def seconds(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - began, 3)

    seconds("norms")  # starts the JVM's and Python's workers
    took = {name: seconds(name) for name in HEADLINE}
    more = {name: seconds(name) for name in MORE}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took | more, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
