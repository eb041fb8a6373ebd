"""Fixed values the ranking rules depend on. They are data, not logic: changing one changes results."""

from __future__ import annotations


# --- fixed values: first public year of a technology ------------------------------------------------
TECH_BIRTH_YEARS: tuple[tuple[str, int], ...] = (
    ("pytorch", 2016), ("transformers", 2017), ("bert", 2018), ("gpt", 2018),
    ("hugging face", 2016), ("huggingface", 2016), ("rag", 2020),
    ("retrieval augmented generation", 2020), ("langchain", 2022), ("llama", 2023),
    ("mistral", 2023), ("pinecone", 2019), ("weaviate", 2018), ("qdrant", 2021),
    ("faiss", 2017), ("sentence-transformers", 2019), ("stable diffusion", 2022),
    ("chatgpt", 2022), ("openai api", 2020), ("lora", 2021), ("qlora", 2023),
    ("kubernetes", 2014), ("docker", 2013), ("react", 2013), ("flutter", 2018),
    ("swift", 2014), ("kotlin", 2016),
)

# --- fixed values: title fragments that disqualify ("hr " keeps its trailing blank) ------------------
DISQUALIFIED_TITLES: tuple[str, ...] = (
    "marketing", "sales", "hr ", "human resource", "operations manager", "operations director", "account manager",
    "account executive", "business development", "content writer", "seo", "brand manager", "graphic design",
    "recruiter", "talent acquisition", "finance", "accountant", "project coordinator", "office manager",
    "customer success", "customer support", "support agent", "supply chain", "procurement", "legal", "lawyer",
    "civil engineer", "mechanical engineer", "electrical engineer",
)

# --- fixed values: past roles that are never quoted in an explanation -------------------------------
NON_TECH_ROLES = (
    "civil", "mechanical", "electrical", "chemical", "marketing", "sales", "hr", "recruiter", "finance",
    "accountant", "legal", "operations", "project manager", "scrum", "business analyst", "content", "seo", "brand",
    "graphic", "designer",
)

# --- fixed values: city names searched in a job description -----------------------------------------
CITIES = (
    "noida", "pune", "bangalore", "bengaluru", "mumbai", "delhi", "hyderabad", "chennai", "kolkata", "gurgaon",
    "gurugram", "ahmedabad", "jaipur", "surat", "lucknow", "kanpur", "nagpur", "indore", "thane", "bhopal",
    "visakhapatnam", "patna", "vadodara", "ghaziabad", "ludhiana", "agra", "nashik", "faridabad", "meerut",
    "rajkot", "kochi", "coimbatore", "chandigarh", "mysore", "bhubaneswar", "greater noida", "ncr", "navi mumbai",
    "trivandrum", "thiruvananthapuram",
)
METRO_TRIGGERS = (
    "delhi", "noida", "gurgaon", "gurugram",
)
METRO_AREA = (
    "delhi", "noida", "gurgaon", "gurugram", "ncr", "greater noida",
)
HOME_COUNTRIES = ("india", "in", "")

# --- fixed values: tiered technical vocabulary ------------------------------------------------------
TIER3 = (
    "pinecone", "weaviate", "qdrant", "milvus", "faiss", "opensearch", "elasticsearch", "pgvector", "chroma",
    "vespa", "typesense", "redis search", "algolia", "solr", "embeddings", "embedding", "semantic search",
    "vector search", "dense retrieval", "sparse retrieval", "hybrid search", "bm25", "reranking", "rerank",
    "information retrieval", "neural search", "recommendation systems", "recommendation", "ranking", "retrieval",
    "rag", "retrieval augmented generation", "ann", "hnsw", "kafka", "redis", "postgresql", "postgres", "cassandra",
    "mongodb", "mysql", "dynamodb", "bigquery", "snowflake", "databricks", "kubernetes", "docker", "terraform",
    "airflow", "spark", "react", "react native", "flutter", "swift", "kotlin", "android", "ios", "typescript",
    "javascript", "nextjs", "nodejs",
)
TIER2 = (
    "pytorch", "tensorflow", "hugging face", "huggingface", "sentence transformers", "sentence-transformers",
    "transformers", "bert", "gpt", "llm", "large language model", "fine-tuning", "fine tuning", "nlp",
    "natural language processing", "computer vision", "langchain", "llamaindex", "openai", "anthropic", "gemini",
    "scikit-learn", "sklearn", "xgboost", "lightgbm", "ndcg", "mrr", "map", "precision", "recall", "a/b testing",
    "evaluation", "offline evaluation", "online evaluation", "f1", "auc", "roc", "python", "golang", "java",
    "scala", "rust", "cpp", "c++", "sql", "graphql", "aws", "gcp", "azure", "s3", "ec2", "lambda", "gke", "eks",
    "mlops", "ml pipeline", "feature engineering", "feature store", "model serving", "model deployment",
    "inference", "latency", "applied ml", "machine learning", "deep learning",
)
TIER1 = (
    "production", "shipped", "scale", "scalable", "distributed", "microservices", "api", "rest", "grpc", "protobuf",
    "ci/cd", "devops", "monitoring", "observability", "data engineering", "etl", "streaming", "batch",
    "neural network", "transformer", "attention", "tokenizer",
)
# tier -> (weight when the description names the term, weight when it does not)
TIER_WEIGHTS = {3: (3.0, 2.0), 2: (2.0, 1.5), 1: (1.0, 0.5)}

# --- fixed values: words without signal -------------------------------------------------------------
GENERIC_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is",
    "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "that", "this", "these", "those", "we", "you", "they", "our", "your", "their",
    "it", "its", "not", "no", "can", "if", "what", "how", "who", "which", "when", "where", "why", "also", "more",
    "any", "all", "both", "each", "few", "most", "other", "some", "such", "than", "then", "so", "yet", "about",
    "above", "after", "before", "between", "into", "through", "during", "role", "team", "work", "build", "use",
    "using", "strong", "experience", "year", "years", "good", "real", "well", "like", "open", "pure", "one", "per",
    "via", "etc", "very", "just", "only", "even", "over", "product", "system", "search", "engineer", "shipped",
    "users", "location", "database", "research", "india", "relocation", "notice", "period", "days", "preferred",
    "attitude", "opinions", "actually", "built", "means", "think", "write", "find", "painful", "style", "abrasive",
    "stable", "mature", "productive", "unstable", "narrow", "explicitly", "genuinely", "active", "clear", "signal",
    "market", "including", "without", "requires", "required", "need", "needs", "want", "looking", "ideal",
    "candidate", "candidates", "hiring", "hire", "join", "company", "startup", "series", "early", "stage",
    "founding", "senior", "junior", "lead", "staff", "principal", "manager", "director", "head", "vp", "cto",
)


def tiered_terms() -> list[tuple[int, str]]:
    """Every vocabulary term once, tier 3 first, terms ascending inside a tier (the pinned order)."""
    return [(tier, term) for tier, terms in ((3, TIER3), (2, TIER2), (1, TIER1)) for term in sorted(terms)]
