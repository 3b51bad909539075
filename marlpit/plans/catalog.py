"""All query modules; importing this registers them."""

from . import conversation, documents, figures, further, jobs, matching, relations, retrieval  # noqa: F401
