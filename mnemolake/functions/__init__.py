from mnemolake.functions import answers, scoring, text, vectors  # noqa: F401
