"""Dataset profiling and data quality on Spark."""

from .operators.ask import ask
from .operators.contract import validate
from .operators.drift import compare
from .operators.issues import collect_warnings, warnings
from .operators.merge import merge
from .operators.ml import ml_ready
from .operators.profile import profile, scan
from .operators.transform import clean, fix
from .report import export, report
from .session import PrismataError, session

__version__ = "0.1.0"
__all__ = ["profile", "scan", "compare", "ml_ready", "warnings", "fix", "clean", "merge", "ask", "report", "export", "collect_warnings", "validate", "session", "PrismataError", "__version__"]
