"""DataFrame operators; each module is imported on its own so that workers load only what they need."""
