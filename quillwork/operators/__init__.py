"""DataFrame operators; each module groups the operators of one data domain."""
