"""stressloom.streaming"""
