"""Schemas, domain values and small dimension tables.

The values under "Fixed values" must equal the domain the library serves
(French public-procurement vocabulary, bucket bounds, model constants);
they are listed plainly and in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Procedure types, public sectors and technical domains, in declaration order.
AO_TYPES = ["MAPA", "Ouvert", "Restreint", "Dialogue compétitif",
            "Partenariat d'innovation", "Concours"]
SECTORS = ["État", "Territorial", "Hospitalier", "Éducation", "EPA/EPIC", "Défense"]
DOMAINS = ["Développement", "Infrastructure/Cloud", "Cybersécurité", "Data/IA",
           "Conseil", "Intégration", "Support/Maintenance"]
COMPLEX_DOMAINS = ["Cybersécurité", "Data/IA", "Intégration"]

# Amount buckets: (exclusive upper bound, label); last bucket has no bound.
AMOUNT_BUCKETS = [(25000, "0-25k"), (100000, "25k-100k"), (500000, "100k-500k"),
                  (1000000, "500k-1M"), (5000000, "1M-5M"), (None, "5M+")]
AMOUNT_UNKNOWN = "Non spécifié"

# Buyer kinds recognised in organisation names (lower case, checked in order).
ORG_KINDS = ["région", "département", "ministère", "chu", "université"]

# Relevance bonuses when the result matches the request context.
BONUS_SECTOR = 0.10
BONUS_TYPE = 0.10
BONUS_AMOUNT = 0.08
BONUS_ORG = 0.05

# Confidence labels from similarity.
CONF_HIGH, CONF_MID, CONF_LOW = "Haute", "Moyenne", "Faible"

# Default collections and descriptions.
DEFAULT_COLLECTIONS = [
    ("reglementaire", "Code des marchés publics, CCAG, jurisprudences, normes sectorielles"),
    ("historique_ao", "Résultats BOAMP/TED, analyses post-attribution, patterns sectoriels"),
    ("references_clients", "Projets détaillés, ROI quantifiés, retours satisfaction"),
    ("templates_performants", "Mémoires techniques gagnants, structures optimales par secteur"),
    ("intelligence_concurrentielle", "Profils détaillés ESN/consultants, stratégies, grilles prix"),
]
ENGINE_VERSION = "1.0.0"

# Embedding models: name, dimension, price per 1k tokens (USD), token limit.
MODELS = [
    ("text-embedding-3-large", 3072, 0.00013, 8191),
    ("text-embedding-3-small", 1536, 0.00002, 8191),
    ("text-embedding-ada-002", 1536, 0.0001, 8191),
]
DEFAULT_MODEL = "text-embedding-3-large"
UNKNOWN_MODEL_DIM = 1536
UNKNOWN_MODEL_PRICE = 0.0001
TOKENS_PER_WORD = 1.3
CACHE_SAVING_PRICE = 0.00013  # per 1k tokens, used for cache savings whatever the model
CACHE_ENTRY_MAX_BYTES = 10 * 1024 * 1024
CACHE_TTL_HOURS = 24
CACHE_MAX_BYTES = 500 * 1024 * 1024
CACHE_TARGET_RATIO = 0.8

# Request limits.
LIMIT_MIN, LIMIT_MAX = 1, 100
DEFAULT_LIMIT = 5
DEFAULT_MIN_SIMILARITY = 0.5
DEFAULT_COLLECTION = "historique_ao"
CANDIDATE_FACTOR = 2

# Error codes: status -> class flags.
RETRYABLE_STATUS_MIN = 500
STATUS_RATE_LIMITED = 429
STATUS_AUTH = (401, 403)

# Alert thresholds for operation KPIs.
ALERT_LATENCY_MS = 500.0
ALERT_MIN_HIT_RATE = 0.5
ALERT_DAILY_COST_USD = 10.0
ALERT_ERROR_RATE = 0.05

# Sensitive key fragments for masking log maps (substring of the lower-cased key).
SENSITIVE_KEYS = ["api_key", "token", "secret", "password", "auth",
                  "email", "phone", "ssn", "credit_card"]
MASK_MIN_LEN = 8   # strings longer than this keep their first and last MASK_KEEP chars
MASK_KEEP = 4

# Request routing modes and their trigger words.
MODE_TRIGGERS = [
    ("ANALYSE_DCE_RAG", ["analyse", "DCE", "qualification", "opportunité"]),
    ("MEMOIRE_TECHNIQUE_RAG", ["mémoire", "technique", "structuration", "rédaction"]),
    ("OPTIMISATION_PRIX_RAG", ["prix", "tarif", "compétitif", "marge", "budget"]),
    ("CONFORMITE_BULLETPROOF_RAG", ["conformité", "réglementaire", "contrôle", "validation"]),
]

# Go/no-go criteria weights (sum 100).
GO_NOGO_WEIGHTS = [
    ("budget_confirme", 25), ("fit_competences", 20), ("competition_level", 20),
    ("margin_potential", 15), ("relationship_access", 10), ("timeline_realistic", 10),
]

# Error codes of the embedding provider and their class.
PROVIDER_ERROR_CODES = [
    ("insufficient_quota", "API_QUOTA_EXCEEDED"), ("rate_limit_exceeded", "API_RATE_LIMIT"),
    ("invalid_api_key", "API_AUTH_ERROR"), ("model_not_found", "API_MODEL_ERROR"),
    ("context_length_exceeded", "API_CONTEXT_ERROR"),
]
# Cache errors after which the entry can be rebuilt.
RECOVERABLE_CACHE_CODES = ["CACHE_CORRUPTED_DATA", "CACHE_EXPIRED_ENTRY", "CACHE_INVALID_KEY", "CACHE_READ_FAILED"]
# Words of configuration keys that concern authentication.
AUTH_CONFIG_WORDS = ["api_key", "secret", "token", "password", "auth"]

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

EMBEDDING_TYPE = T.ArrayType(T.FloatType())

CONTEXT_TYPE = T.StructType([
    T.StructField("ao_type", T.StringType(), True),
    T.StructField("sector", T.StringType(), True),
    T.StructField("estimated_amount", T.LongType(), True),
    T.StructField("technical_domains", T.ArrayType(T.StringType()), True),
    T.StructField("organisme", T.StringType(), True),
])
