import public_tokenizers


def tokenizer(name: str) -> str:
    return public_tokenizers.path(name)
