import corpus_pipeline
from strandframe.llm import tokens


def test_an_encoder_forgets_pieces_and_encodes_alike():
    coder = tokens.PieceEncoder(tokens.default_path("byte_bpe_50k.json"))
    ids = coder.encode(["some words, twice: some words"])
    assert coder.kept or coder.older
    coder.forget()
    assert not coder.kept and not coder.older
    assert coder.encode(["some words, twice: some words"]) == ids


def test_the_pipeline_keeps_no_pieces_after_a_task(monkeypatch):
    given = {}
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda docs, path, **more: given.update(more))
    corpus_pipeline.pack(None, None, "")
    assert given == {"keep": False}
