"""Word lists from which the adapter derives profiles and descriptions out of the driver tables."""

from __future__ import annotations

TITLES = [
    "Senior ML Engineer", "Staff Machine Learning Engineer", "Marketing Manager", "Junior ML Engineer",
    "Data Scientist", "Civil Engineer", "Lead Search Engineer", "HR Manager", "AI Engineer",
    "Salesforce Developer", "Head of Search", "Internal Tools Engineer", "Backend Engineer",
    "Principal Data Engineer", "HR", "Applied Scientist",
]
PLACES = [
    "Noida, Uttar Pradesh", "Pune, Maharashtra", "Kochi, Kerala", "Mumbai, Maharashtra", "Austin, Texas",
    "Hyderabad, Telangana", "", "Greater Noida", "Chennai, Tamil Nadu", None,
]
COUNTRIES = ["India", "india", "IN", "", "USA", None]
COMPANIES = ["Acme", "Globex Corp", "Initech", "", "Umbrella  Labs", "Hooli", None]
ROLES = [
    "Search Engineer", "ML Engineer", "Project Manager", "Data Engineer", "Recruiter", "AI Researcher",
    "Software Engineer", None, "Content Writer", "Ranking Engineer", "Mechanical Designer", "Platform Engineer",
]
DUTIES = [
    "Built embeddings and semantic search with FAISS in production",
    "Shipped a recommendation system to users at scale",
    "Ran the payroll and the office",
    "Fine-tuning of BERT and other transformers for NLP",
    None,
    "Kafka and Spark streaming pipelines, batch ETL on AWS",
    "React and TypeScript front end",
    "Offline evaluation with NDCG and MRR, A/B testing",
    "",
    "Kubernetes platform, monitoring and observability",
]
SKILLS = [
    "Pinecone", "FAISS", "Embeddings", "Python", "PyTorch", "RAG", "LangChain", "Photoshop", "Excel", "QLoRA",
    "Storage Systems", "Kubernetes", "NLP", "", "Elasticsearch", "BM25", "Milvus", "SQL", "Java",
    "Recommendation Systems", "Semantic Search", "Information Retrieval", "Sentence Transformers",
    "Computer Vision", "Spark", "Kafka", "Airflow", "OpenSearch",
]
LEVELS = ["expert", "advanced", "intermediate", "beginner", "unknown", None]

# One description per region.
REGION_JDS = [
    """Search Engineer, Noida or Pune, India. 5-9 years of work on retrieval. Embeddings, semantic search, FAISS,
Pinecone, BM25 and hybrid search in production. Python, NDCG and MRR, learning-to-rank, sub-30-day notice.
Transformers, RAG and fine-tuning are a plus; recommendation and ranking systems at scale.""",
    """Data platform role in Mumbai or Chennai. At least 3 years with Spark, Kafka and Airflow. SQL, Java or Scala,
streaming and batch ETL, Kubernetes and Docker on AWS. Monitoring, distributed systems, event-driven design.""",
    """Applied NLP lead, Hyderabad. 6+ years. BERT, large language model work, LangChain, inference latency, MLOps,
PyTorch, evaluation, natural language processing, tokenizer work, gpt4 and llama3 models.""",
    """Remote generalist. Minimum 2 yrs. Python and SQL, react and typescript, rest api, ci/cd.""",
    """Gardener for a large park. Careful planting, pruning and planting of roses; tools are provided.""",
]

# Parts of one description per nation: narrow and wide ranges of years, common and rare places.
NATION_YEARS = [
    "12 to 14 years of search work.", "13 to 13 years in ranking.", "14+ years.", "5-9 years of work on retrieval.", "Minimum 2 yrs.",
]
NATION_PLACES = ["Based in Kochi.", "Chennai or Kochi.", "Noida.", "Jaipur.", "Any place."]
NATION_TERMS = [
    "Embeddings, FAISS and Python in production.", "Kafka, Spark, SQL and gpt4.", "Semantic search, BM25, Pinecone, RAG and ranking.",
]

# Openings and closings put around every document to make it a description.
JD_OPENINGS = [
    "We ask for 5-9 years.", "Needs 4+ years of practice.", "Minimum 3 years please.", "At least 2 yrs here.",
    "7 years of experience wanted.", "3 to 5 yrs of work.", "No years are asked.", "Between 10 – 12 years at least 8 years.",
]
JD_CLOSINGS = [
    "Noida or Pune. Embeddings, FAISS, Pinecone, BM25, reranking.", "Mumbai. Kafka, Spark, SQL, docker, large-scale systems.",
    "Greater Noida, NCR.", "Delhi. vue3 and next.js, learning-to-rank.", "", "Python, NLP, BERT, LLM, gpt4, computer vision.",
    "Kochi; rag and storage.", "Anywhere. api, rest, scala, java, c++, ci/cd, a/b testing.",
]
