"""Intentionally empty.

The reference reads every input as a complete file once; it has no
stream, watermark, stream window or stateful operator, so nothing here is
built.  The batch jobs are plain DataFrame plans and could be driven from
``foreachBatch`` if a stream ever feeds them.
"""
