"""Patterns and names that paper texts are searched for; all are parameters of the operators that use them."""

#: Spellings that open an abstract, in order of preference, and patterns that end it.
ABSTRACT_OPENS = ("A B S T R A C T", "ABSTRACT", "Abstract", "A b s t r a c t", "Abstract—")
ABSTRACT_ENDS = (r"\bKeywords?\b", r"\bKEYWORDS\b", r"\bNomenclature\b", r"\b1\.\s*Introduction\b", r"\bIntroduction\b", r"\bIndex Terms\b", r"©\s*20\d\d", r"\bArticle history\b")

#: Rules for the year of publication, in order of preference.
YEAR_RULES = (
    r"(?i)(?:Available\s*online|Published\s*online|First\s*published|Published)[^\n]{0,60}?(20[0-2]\d)",
    r"VOL\.[^\n]{0,60}?(20[0-2]\d)",
    r"(?:©|Copyright)[^\n]{0,120}?(20[0-2]\d)",
    r"(?i)Accepted[^\n]{0,60}?(20[0-2]\d)",
    r"(?<!\d)(20[0-2]\d)(?!\d)",
)

DOI = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"

JOURNALS = (
    "Aerospace Science and Technology",
    "Chinese Journal of Aeronautics",
    "Structural and Multidisciplinary Optimization",
    "International Journal of Heat and Mass Transfer",
    "International Journal of Heat and Fluid Flow",
    "Engineering Optimization",
    "IEEE Transactions on Cybernetics",
    "Applied Thermal Engineering",
    "Journal of Turbomachinery",
)

METHODS = {
    "Kriging / Gaussian process": r"\b(Kriging|kriging|Gaussian process|GP model)\b",
    "Expected improvement (EI)": r"\b(expected improvement|\bEI\b|acquisition function)\b",
    "Multi-fidelity / Co-Kriging": r"\b(multi-?fidelity|co-?kriging|multi-?form)\b",
    "Differential evolution": r"\b(differential evolution|\bDE\b|evolutionary algorithm)\b",
    "Decomposition / subspace": r"\b(decompos\w+|sub-?space|subspace)\b",
    "Generative model (GAN/VAE)": r"\b(generative adversarial|\bGAN\b|\bVAE\b|latent space)\b",
    "Transfer / knowledge reuse": r"\b(transfer learning|knowledge transfer|negative transfer)\b",
    "Neural operator / deep net": r"\b(neural operator|deep neural network|transformer|UNet|ResUNet)\b",
    "Physics-enhanced / SHAP": r"\b(physics-?(enhanced|informed)|\bSHAP\b|superposition principle)\b",
    "Uncertainty quantification": r"\b(uncertainty quantific\w+|\bUQ\b|polynomial chaos|\bANOVA\b)\b",
}

CLAIMS = (
    r"[^\n.]{0,150}\b\d+(?:\.\d+)?\s?%[^\n.]{0,150}\.",
    r"[^\n.]{0,150}\b\d+(?:\.\d+)?\s?(?:dimensional|-D|dimensions|variables)\b[^\n.]{0,150}\.",
    r"[^\n.]{0,150}\b(?:reduced|improved|increased|decreased|saving|saved|speedup|faster)\b[^\n.]{0,150}\.",
)

#: What each claim pattern must find in a line to match there.
CLAIM_CORES = (r"\d\s?%", r"\d\s?(?:dimensional|-D|dimensions|variables)\b", r"\b(?:reduced|improved|increased|decreased|saving|saved|speedup|faster)\b")
