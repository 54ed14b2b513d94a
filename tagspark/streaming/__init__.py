"""Posts that arrive one after another: cleaning and scoring on a stream."""
