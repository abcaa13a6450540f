"""Column expressions (JVM-side, no Python UDFs)."""

from labelscope.functions.text import (  # noqa: F401
    basename, decode_source_bytes, extension, parent_dir, path_parts, py_strip, stem,
)
from labelscope.functions.labels import (  # noqa: F401
    is_ignored_label, normalize_label, origin_of,
)
from labelscope.functions.numeric import strict_number  # noqa: F401
from labelscope.functions.scores import f1_score, precision, recall  # noqa: F401
from labelscope.functions.jsonx import strict_json  # noqa: F401
