from sparkrisk.functions.exprs import *  # noqa: F401,F403
from sparkrisk.functions.exprs import __all__  # noqa: F401
