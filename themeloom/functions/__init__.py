from themeloom.functions import text, vectors  # noqa: F401
