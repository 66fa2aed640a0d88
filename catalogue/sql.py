"""SQL building blocks: the whole job as common table expressions, written for a single node."""

from __future__ import annotations

PATTERN = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*"

TF = {
    "binary": "1.0::DOUBLE",
    "raw_count": "cnt::DOUBLE",
    "normalization": "cnt::DOUBLE / total",
    "double_normalization_half": "0.5::DOUBLE + 0.5::DOUBLE * cnt / mx",
    "double_normalization_variable": "{k}::DOUBLE + (1.0::DOUBLE - {k}::DOUBLE) * cnt / mx",
}
IDF = {
    "base": "ln(n::DOUBLE / df)",
    "smooth": "ln(n::DOUBLE / (1 + df)) + 1.0::DOUBLE",
    "maximum": "ln(max_df::DOUBLE / (1 + df))",
    "probabilistic":
        "CASE WHEN df >= n THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, ln((n - df)::DOUBLE / df)) END",
}


def with_ctes(ctes: list[tuple[str, str]], select: str) -> str:
    body = ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in ctes)
    return f"WITH {body}\n{select}"


def docs(table: str = "documents", key: str = "doc_id", text: str = "text", label: str = "lang"):
    return [("docs", f"SELECT {key} AS doc_id, {text} AS text, "
                     f"CAST({label} AS VARCHAR) AS label_id FROM {table}")]


def counts(source: str = "docs", prefix: str = "") -> list[tuple[str, str]]:
    """Term counts and per-document statistics of ``doc_id, text`` rows (one row per page)."""
    return [
        (f"{prefix}tok", f"SELECT doc_id, unnest(regexp_extract_all(lower(text), '{PATTERN}')) "
                         f"AS term FROM {source}"),
        (f"{prefix}tf", f"SELECT doc_id, term, count(*) AS cnt FROM {prefix}tok GROUP BY ALL"),
        (f"{prefix}st", f"SELECT doc_id, sum(cnt)::BIGINT AS total, max(cnt) AS mx "
                        f"FROM {prefix}tf GROUP BY doc_id"),
    ]


def weighted(tf: str = "raw_count", k: float = 0.5, prefix: str = "") -> list[tuple[str, str]]:
    weight = TF[tf].format(k=k)
    return [(f"{prefix}tw", f"SELECT t.doc_id, t.term, {weight} AS tfw FROM {prefix}tf t "
                            f"JOIN {prefix}st s ON t.doc_id = s.doc_id")]


def split_hash(seed: int) -> str:
    return (f"md5(concat_ws(':', '{seed}', CAST(r.split_index AS VARCHAR), "
            "CAST(d.doc_id AS VARCHAR)))")


def stratified(ratio: float, reps: int, seed: int) -> list[tuple[str, str]]:
    return [
        ("reps", f"SELECT CAST(range AS INTEGER) AS split_index FROM range({reps})"),
        ("sized", "SELECT doc_id, label_id, count(*) OVER (PARTITION BY label_id) AS n FROM docs"),
        ("asg", f"""SELECT r.split_index, d.doc_id, d.label_id,
             row_number() OVER (PARTITION BY r.split_index, d.label_id
                                ORDER BY {split_hash(seed)}, d.doc_id)
             <= greatest(1, least(n - 1,
                 floor(CAST(n AS REAL) * CAST({ratio} AS REAL))::BIGINT)) AS is_train
             FROM sized d CROSS JOIN reps r"""),
    ]


def randomly(ratio: float, reps: int, seed: int) -> list[tuple[str, str]]:
    return [
        ("reps", f"SELECT CAST(range AS INTEGER) AS split_index FROM range({reps})"),
        ("sized", "SELECT doc_id, label_id, count(*) OVER () AS n FROM docs"),
        ("asg", f"""SELECT r.split_index, d.doc_id, d.label_id,
             row_number() OVER (PARTITION BY r.split_index
                                ORDER BY {split_hash(seed)}, d.doc_id)
             <= floor(CAST(n AS REAL)
                      * CAST(greatest(0.0, least(1.0, {ratio})) AS REAL))::BIGINT AS is_train
             FROM sized d CROSS JOIN reps r"""),
    ]


def fitted(idf: str = "base") -> list[tuple[str, str]]:
    """Vocabulary and weights of every split, from training documents."""
    return [
        ("nn", "SELECT split_index, count(*) AS n FROM asg WHERE is_train GROUP BY ALL"),
        ("dfs", "SELECT a.split_index, t.term, count(*) AS df FROM asg a JOIN tf t "
                "ON a.doc_id = t.doc_id WHERE a.is_train GROUP BY ALL"),
        ("mdf", "SELECT split_index, max(df) AS max_df FROM dfs GROUP BY ALL"),
        ("idf", f"SELECT split_index, term, df, {IDF[idf]} AS idf FROM dfs JOIN nn "
                "USING (split_index) JOIN mdf USING (split_index)"),
        ("feat", "SELECT * FROM (SELECT a.split_index, a.doc_id, a.label_id, a.is_train, w.term, "
                 "w.tfw * i.idf AS weight FROM asg a JOIN tw w ON a.doc_id = w.doc_id JOIN idf i "
                 "ON i.split_index = a.split_index AND i.term = w.term) WHERE weight <> 0"),
    ]


def classified() -> list[tuple[str, str]]:
    """Class means, and the nearest class of every document in every split."""
    return [
        ("cn", "SELECT split_index, label_id, count(*) AS n FROM asg WHERE is_train GROUP BY ALL"),
        ("cent", "SELECT split_index, label_id, term, sum(weight) / any_value(n) AS mean FROM feat "
                 "JOIN cn USING (split_index, label_id) WHERE is_train GROUP BY ALL"),
        ("norms", "SELECT split_index, label_id, sum(mean * mean) AS c2 FROM cent GROUP BY ALL"),
        ("classes", "SELECT cn.split_index, cn.label_id, cn.n, coalesce(c2, 0.0) AS c2 FROM cn "
                    "LEFT JOIN norms USING (split_index, label_id)"),
        ("dots", "SELECT f.split_index, f.doc_id, c.label_id AS class_id, sum(f.weight * c.mean) "
                 "AS dot FROM feat f JOIN cent c ON f.split_index = c.split_index "
                 "AND f.term = c.term GROUP BY ALL"),
        ("own", "SELECT split_index, doc_id, sum(weight * weight) AS x2 FROM feat GROUP BY ALL"),
        ("dist", """SELECT a.split_index, a.doc_id, a.label_id, a.is_train, c.label_id AS class_id,
             coalesce(x2, 0.0) AS x2,
             greatest(0.0, coalesce(x2, 0.0) - 2 * coalesce(dot, 0.0) + c2) AS d2
             FROM asg a JOIN classes c ON a.split_index = c.split_index
             LEFT JOIN dots d ON d.split_index = a.split_index AND d.doc_id = a.doc_id
               AND d.class_id = c.label_id
             LEFT JOIN own o ON o.split_index = a.split_index AND o.doc_id = a.doc_id"""),
        ("ranked", "SELECT *, row_number() OVER (PARTITION BY split_index, doc_id "
                   "ORDER BY d2, class_id) AS rn FROM dist"),
        ("pred", "SELECT split_index, doc_id, label_id, is_train, class_id AS predicted, "
                 "sqrt(d2) AS dist FROM ranked WHERE rn = 1"),
    ]


def judged() -> list[tuple[str, str]]:
    """Scores of every split and part, and their comparison."""
    return [
        ("conf", "SELECT split_index, CASE WHEN is_train THEN 'train' ELSE 'test' END AS part, "
                 "label_id, predicted, count(*) AS n FROM pred GROUP BY ALL"),
        ("marg", """SELECT split_index, part, class, sum(a)::BIGINT AS actual,
             sum(p)::BIGINT AS predicted, sum(c)::BIGINT AS correct FROM (
             SELECT split_index, part, label_id AS class, n AS a, 0 AS p,
                    CASE WHEN label_id = predicted THEN n ELSE 0 END AS c FROM conf
             UNION ALL
             SELECT split_index, part, predicted, 0, n, 0 FROM conf) GROUP BY ALL"""),
        ("sums", """SELECT split_index, part, sum(actual)::BIGINT AS samples,
             avg(2.0::DOUBLE * correct / (actual + predicted)) AS macro_f1,
             avg(CASE WHEN actual > 0 THEN correct::DOUBLE / actual END) AS balanced_accuracy,
             sum(correct)::DOUBLE * sum(actual)::DOUBLE
               - sum(actual::DOUBLE * predicted) AS above,
             sqrt((power(sum(actual)::DOUBLE, 2) - sum(actual::DOUBLE * actual))
                * (power(sum(actual)::DOUBLE, 2) - sum(predicted::DOUBLE * predicted))) AS below
             FROM marg GROUP BY ALL"""),
        ("met", """SELECT split_index, part, samples, macro_f1, balanced_accuracy,
             CASE WHEN below > 0 THEN greatest(-1.0, least(1.0, above / below)) ELSE 0.0 END
               AS matthews_correlation FROM sums"""),
        ("ev", """SELECT a.split_index, a.samples AS train_samples, b.samples AS test_samples,
             a.macro_f1 AS train_macro_f1, a.balanced_accuracy AS train_balanced_accuracy,
             a.matthews_correlation AS train_matthews_correlation,
             b.macro_f1 AS test_macro_f1, b.balanced_accuracy AS test_balanced_accuracy,
             b.matthews_correlation AS test_matthews_correlation,
             abs(a.macro_f1 - b.macro_f1) AS gap_macro_f1,
             abs(a.balanced_accuracy - b.balanced_accuracy) AS gap_balanced_accuracy,
             abs(a.matthews_correlation - b.matthews_correlation) AS gap_matthews_correlation
             FROM met a JOIN met b ON a.split_index = b.split_index AND a.part = 'train'
             AND b.part = 'test'"""),
    ]


def selected(strategy: str = "macro_f1") -> list[tuple[str, str]]:
    return [("best", f"SELECT split_index FROM ev ORDER BY test_{strategy} DESC, "
                     f"gap_{strategy}, split_index LIMIT 1")]


def run(
    label: str = "lang",
    table: str = "documents",
    tf: str = "raw_count",
    idf: str = "base",
    ratio: float = 0.8,
    reps: int = 3,
    seed: int = 42,
    sampling: str = "stratified",
    strategy: str = "macro_f1",
    k: float = 0.5,
) -> list[tuple[str, str]]:
    """A whole training run."""
    split = stratified if sampling == "stratified" else randomly
    return [
        *docs(table, label=label),
        *counts(),
        *weighted(tf, k),
        *split(ratio, reps, seed),
        *fitted(idf),
        *classified(),
        *judged(),
        *selected(strategy),
    ]


def fit_all(table: str = "documents", tf: str = "raw_count", idf: str = "base", k: float = 0.5):
    """TF-IDF fitted on a whole table."""
    return [
        *docs(table),
        *counts(),
        *weighted(tf, k),
        ("nn", "SELECT count(*) AS n FROM docs"),
        ("dfs", "SELECT term, count(*) AS df FROM tf GROUP BY ALL"),
        ("mdf", "SELECT max(df) AS max_df FROM dfs"),
        ("idf", f"SELECT term, df, {IDF[idf]} AS idf FROM dfs, nn, mdf"),
    ]
