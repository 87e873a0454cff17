"""Operations of a training-data pipeline, as DataFrame-to-DataFrame functions."""
