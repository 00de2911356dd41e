"""Operations of training-data pipelines on texts, vectors and web pages."""
